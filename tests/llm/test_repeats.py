import hashlib
import random
import re
from collections import Counter

import pytest

from tallyrail.llm import repeats


def brute(rows, size):
    bodies = [(k, (t or "").encode()) for k, t in rows]
    counts = Counter(b[p : p + size] for _, b in bodies for p in range(len(b) - size + 1))
    out = []
    for key, b in bodies:
        gone = [False] * len(b)
        for p in range(len(b) - size + 1):
            if counts[b[p : p + size]] > 1:
                gone[p : p + size] = [True] * size
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(10, 60))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(0, 5))]
        rows.append((k, "".join(parts)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "a" * 90), (5, rows[5][1]), (None, passages[0]), (n + 3, passages[0])]


@pytest.mark.parametrize("limit", [4096, 1])
@pytest.mark.parametrize("size", [14, 37])
def test_against_brute_force(spark, monkeypatch, limit, size):
    monkeypatch.setattr(repeats, "GROUP_LIMIT", limit)
    rows = corpus(size)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, spans string")
    assert order(repeats.without_repeats(docs, size).collect()) == order(brute(rows, size))


def test_long_documents_are_hashed_in_parts(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abc") for _ in range(2900))
    rows = [(0, text), (1, text[200:900] + "z" * 50), (2, text[:100]), (3, text[1000:1041]), (4, "y" + text[1500:1540])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (256, 1000):
        assert order(repeats.without_repeats(docs, 40, part=part).collect()) == order(brute(rows, 40))


def test_sizes(spark):
    assert repeats.gram_of(400, False) == 160 and repeats.gram_of(51, True) == 24
    docs = spark.createDataFrame([(0, "abab"), (1, "xab")], "doc_id long, text string")
    assert order(repeats.without_repeats(docs, 2).collect()) == order(brute([(0, "abab"), (1, "xab")], 2))
    with pytest.raises(ValueError):
        repeats.without_repeats(docs, 1)


def test_query_has_the_contract_and_the_text_without_passages(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = repeats.op8_column_wise_repeats(spark, small).collect()
    assert order(r[:5] for r in got) == order(brute(rows, 400))
    assert {r.doc_id: r.text for r in got} == both_brute(rows, 400, 51)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.without_repeats(docs).count() == 0


def both_brute(rows, size, words):
    """doc_id -> what is left of the text's bytes, by counting every string of bytes and of words."""
    bodies = {k: (t or "").encode() for k, t in rows}
    spots = {k: [(len(t[: m.start()].encode()), len(t[: m.end()].encode())) for m in re.finditer(r"\S+", t)] for k, t in ((k, t or "") for k, t in rows)}
    parts = {k: [bodies[k][b:e] for b, e in spots[k]] for k in bodies}
    counts = Counter(hash(tuple(p[i : i + words])) for p in parts.values() for i in range(len(p) - words + 1))
    strings = Counter(hash(t[i : i + size]) for t in bodies.values() for i in range(len(t) - size + 1))
    out = {}
    for k, t in bodies.items():
        gone = bytearray(len(t))
        cuts = [(spots[k][i][0], spots[k][i + words - 1][1]) for i in range(len(parts[k]) - words + 1) if counts[hash(tuple(parts[k][i : i + words]))] > 1]
        cuts += [(i, i + size) for i in range(len(t) - size + 1) if strings[hash(t[i : i + size])] > 1]
        for b, e in cuts:
            gone[b:e] = b"1" * (e - b)
        out[k] = bytes(c for c, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


@pytest.mark.parametrize("limit", [4096, 1])
def test_words_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(repeats, "GROUP_LIMIT", limit)
    rnd = random.Random(4)
    word = lambda: rnd.choice(["a", "be", "see", "it", "go", "word"])
    passages = [[word() for _ in range(rnd.randint(5, 20))] for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else [word() for _ in range(rnd.randint(0, 9))] for _ in range(rnd.randint(0, 5))]
        rows.append((k, "".join(w + rnd.choice([" ", "\n", "  ", "\u3000", "\xa0"]) for p in parts for w in p)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kept for r in repeats.without_repeats(docs, 400, whole=True, words=8).collect()}
    assert got == both_brute(rows, 400, 8)
