import random
import re

import pytest

from tallyrail.llm import minhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = {k: k for k, _ in rows if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            common, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if a is not None and b is not None and union and 100 * common >= 75 * union:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted([(k, len(s), None if k is None else find(k), k is None or find(k) == k) for (k, _), s in zip(rows, sets, strict=True)], key=repr)


def corpus(seed, bases=8, copies=14, length=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(4))
    texts = []
    for _ in range(bases):
        base = [word() for _ in range(rnd.randint(3, length))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 4, 5, 8])):
                w[rnd.randrange(len(w))] = word().upper()
            texts.append(rnd.choice([" ", "\n", "\t "]).join(w))
    texts += [None, "", " \n", "one two", "One  two\x0b", "a", "x" * 5000 + " y"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [512, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(block) + [(None, "p q r s t u"), (900, "p q r s t u"), (900, "p q r s t u")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, band string")
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=repr) == brute(rows)


def test_large_buckets_go_on_unfiltered(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_LIMIT", 2)
    rows = corpus(5, bases=4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
