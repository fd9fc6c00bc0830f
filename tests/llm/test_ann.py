import math
import random

import numpy as np
import pytest

from tallyrail.llm import ann


def brute(rows, k):
    rows = {i: v for i, v in rows if v and i is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in rows.items():
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def searched(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")
    out = {}
    for r in sorted(ann.nearest(df, lambda i: i % 20 == 0, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("uneven", [False, True])
def test_all_probes_give_the_exact_answer(spark, uneven):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(120, 8)).astype(np.float32)
    if not uneven:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[30:80] = x[0]  # a hot vector, a query among its copies
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(200, None), (220, []), (240, [0.0] * 8), (260, [math.nan] * 8), (280, [1.0] * 7 + [None]), (300, [math.inf] * 8), (None, rows[1][1]), (5, rows[5][1])]
    got, want = searched(spark, rows, k=20, probes=256), brute(rows, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_fewer_rows_than_neighbours_and_none(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(0, 60, 20)]
    assert {q: len(v) for q, v in searched(spark, rows, probes=256).items()} == {0: 2, 20: 2, 40: 2}
    assert searched(spark, []) == {}


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = brute(rows, 20)
    got = {}
    for r in ann.op1_cross_polytope(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got.get(q, set()) & {i for i, _ in v}) for q, v in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("norms", ["one long", "few long", "spread"])
def test_recall_with_uneven_norms(spark, norms):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "spread":
        x *= np.exp(rnd.normal(size=(4000, 1)) / 2)
    else:
        x[7 : 8 if norms == "one long" else 12] *= 3
    x = x.astype(np.float32)
    got = searched(spark, [(i, [float(a) for a in v]) for i, v in enumerate(x)])
    hits = 0
    for q in range(0, len(x), 20):
        scores = x.astype(float) @ x[q].astype(float)
        scores[q] = -np.inf
        hits += len({i for i, _ in got.get(q, [])} & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(range(0, len(x), 20))


def test_queries_with_few_candidates_are_compared_with_all(spark, monkeypatch):
    """One query lies among nine others, and all other vectors point away from it: none is in a probed bucket."""
    rnd = np.random.default_rng(4)
    side = np.where(np.arange(200)[:, None] < 10, 1, -1) * rnd.normal(size=64)
    x = side + rnd.normal(size=(200, 64)) / 10
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    got, want = searched(spark, rows), brute(rows, 20)
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] and {len(v) for v in got.values()} == {20}
    # the same in several blocks of queries and parts of vectors, with hardly any candidates from buckets
    monkeypatch.setattr(ann, "BUCKET_ROWS", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    got = searched(spark, rows, tables=1, probes=1)
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] and {len(v) for v in got.values()} == {20}


def test_compared_in_blocks_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_ROWS", 70)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    rnd = np.random.default_rng(5)
    x = rnd.integers(-2, 3, size=(300, 6)).astype(np.float32)  # many ties
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<float>")
    found = ann.compared(df.filter("id % 20 = 0"), 15, df, 300, 25)
    got = {}
    for r in ann.short_lists(found, 25).collect():
        got.setdefault(r.question, set()).add(r.id)
    for q in range(0, 300, 20):
        scores = x.astype(float) @ x[q].astype(float)
        assert got[q] == set(np.lexsort((np.arange(300), -scores))[:25].tolist())
