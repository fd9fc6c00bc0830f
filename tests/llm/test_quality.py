import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyrail.llm import quality


def test_estimation_finds_the_better_labellers():
    """Votes drawn from known accuracies: the posterior has to beat a majority vote."""
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.2
    rights = [0.95, 0.9, 0.55, 0.55, 0.55]
    votes = np.stack([np.where(rng.random(len(truth)) < r, truth, ~truth) for r in rights], axis=1)
    votes = np.where(votes, quality.DROP, quality.KEEP)
    keys, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    found = quality.estimated({tuple(k): int(c) for k, c in zip(keys.tolist(), n, strict=True)}, 0.2)
    q = np.array([found[tuple(k)] for k in keys.tolist()])[at.reshape(-1)]
    assert ((q >= 0.5) == truth).mean() > ((votes == quality.DROP).sum(axis=1) >= 3).astype(bool).__eq__(truth).mean()
    assert quality.estimated({}, 0.1) == {}


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    """Trained with half of the labels, judged on the other half."""
    docs, labels = tables
    scored = {r.doc_id: r for r in quality.classify(docs, labels.filter("doc_id % 2 = 0")).collect()}
    assert len(scored) == docs.count()
    junk = clean = right_junk = right_clean = 0
    for r in labels.filter("doc_id % 2 = 1").collect():
        if r.quality == 0:
            junk, right_junk = junk + 1, right_junk + scored[r.doc_id].rejected
        elif r.toxic == 0:
            clean, right_clean = clean + 1, right_clean + (not scored[r.doc_id].rejected)
    assert right_junk >= 0.9 * junk and right_clean >= 0.95 * clean


def test_odd_rows(spark, tables):
    corpus, labels = tables
    rows = [(None, None), (-1, ""), (-2, " \n"), (-3, "two words"), (-4, "same " * 50_000), (-5, "A fine text of eight words."), (-5, "A fine text of eight words.")]
    odd = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, rejected boolean")
    docs = corpus.select("doc_id", "text").withColumn("rejected", F.lit(False)).union(odd)
    got = quality.classify(docs, labels.limit(0)).collect()
    assert len(got) == corpus.count() + len(rows)
    by = {r.doc_id: r for r in got}
    assert not by[-1].rejected and not by[-2].rejected and not by[None].rejected and by[-4].rejected
    assert quality.classify(docs.limit(0), labels).count() == 0


def plain_posteriors(rows, prior):
    """Expectation-maximisation document by document, in plain loops, by the same rules."""
    q = []
    for votes in rows:
        drops, keeps = sum(v == quality.DROP for v in votes), sum(v == quality.KEEP for v in votes)
        q.append(min(0.95, 0.6 + 0.2 * drops) if drops else 0.05 if keeps else prior)
    for _ in range(quality.ROUNDS):
        share = [(sum(1 - x for x in q) + 1) / (len(q) + 2), (sum(q) + 1) / (len(q) + 2)]
        seen = {}
        for k in range(len(rows[0])):
            for v in (-1, 0, 1):
                own = [1.0, 1.0]
                for votes, x in zip(rows, q, strict=True):
                    if votes[k] == v:
                        own[0] += 1 - x
                        own[1] += x
                rate = [own[0] / (sum(1 - x for x in q) + 3), own[1] / (sum(q) + 3)]
                if v:
                    right = 1 if v == 1 else 0
                    rate[1 - right] = min(rate[1 - right], rate[right] / quality.BETTER)
                seen[k, v] = rate
        for i, votes in enumerate(rows):
            odds = math.log(share[1] / share[0]) + sum(math.log(seen[k, v][1] / seen[k, v][0]) for k, v in enumerate(votes))
            q[i] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
            if quality.DROP not in votes:
                q[i] = min(q[i], 0.4)
    return q


def test_query_against_plain_loops(spark):
    """Votes, posteriors and scores of the smallest table, worked out again with strings and loops."""
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.trained(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}

    def one(text):
        return quality.Words(*quality.utf8(pa.array([text])))

    rows = {"junk": {}, "toxic": {}}
    for key, text in texts.items():
        words = [w for w in re.split(r"[ \t-\r]+", text) if w]
        if not words:
            continue
        core = [re.sub(r"^[^0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff]+$", "", w) for w in words]
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), c) for c in core]
        n = len(words)
        letters = [re.findall("[A-Za-z]", w) for w in words]
        tail = [0 if not c else len(w) - len(w[: w.rindex(c) + len(c)]) for w, c in zip(words, core, strict=True)]
        share = [
            sum(a == b for a, b in zip(low, low[1:], strict=False)) / n, sum(len(x) >= 2 and all(c.isupper() for c in x) for x in letters) / n,
            sum(t >= 3 for t, c in zip(tail, core, strict=True) if c) / n, sum(not c for c in core) / n, sum(a == b for a, b in zip(low, low[2:], strict=False)) / n,
            sum(t == 2 for t, c in zip(tail, core, strict=True) if c) / n,
        ]
        bare = [len(w) for w, c in zip(words, core, strict=True) if not c]
        share[2], share[5] = share[2] + sum(x >= 3 for x in bare) / n, share[5] + sum(x == 2 for x in bare) / n
        got = one(text).measures()[0]
        assert np.allclose(got, share), (key, got, share)
        drop = [int(s >= t) for s, t in zip(share, (0.25, 0.4, 0.3, 0.2, 0.25, 0.4), strict=True)]
        keep = -int(all(s <= t for s, t in zip(share, (0.05, 0.1, 0.05, 0.05, 0.08, 0.1), strict=True)))
        rows["junk"][key] = (0,) * 7 if n < 5 else (*drop, keep)
        insult = int(bool(set(low) & set(quality.INSULTS.split())))
        rows["toxic"][key] = (insult, *quality.word_list_votes(one(text), model.lists[1:])[0].tolist())
    for task, prior in (("junk", 0.1), ("toxic", 0.05)):
        found = plain_posteriors(list(rows[task].values()), prior)
        assert np.allclose(found, [model.posteriors[task][v] for v in rows[task].values()], atol=1e-9)
    scored = {r.doc_id: r for r in quality.op6_weak_label_quality(spark, folder).collect()}
    assert scored.keys() == texts.keys()
    for key, text in texts.items():
        for task in ("junk", "toxic"):
            want = 0.0
            if key in rows[task]:
                row, slot, value = quality.features(one(text), one(text).measures())
                w = model.weights[task]
                z = w[-1] + sum(w[s] * v for s, v in zip(slot.tolist(), value.tolist(), strict=True))
                z += sum(w[quality.MEASURES + 2 * k + (v == 1)] for k, v in enumerate(rows[task][key]) if v)
                want = 1 / (1 + math.exp(-max(-30, min(30, z))))
            assert abs(getattr(scored[key], task) - want) < 2e-6
        assert scored[key].rejected == (scored[key].junk >= 0.5 or scored[key].toxic >= 0.5)


def test_empty_documents(spark, tables):
    docs, labels = tables
    assert quality.classify(docs.limit(0), labels).count() == 0 and quality.without_rejected(docs.limit(0), labels.limit(0)).count() == 0


def test_fitting_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_BYTES", 1000)
    docs = spark.createDataFrame([(k, "x" * (90 if k else 5000)) for k in range(50)], "doc_id long, text string")
    rows = quality.fitting_sample(docs).collect()
    assert 1 <= len(rows) <= 12 and sum(len(r.text) for r in rows[1:]) <= 1000
