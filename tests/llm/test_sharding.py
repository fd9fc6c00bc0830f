import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tallyrail.llm import sharding


def frame(spark):
    rows = [(k, f"text {k % 7}") for k in range(3000)] + [(None, None), (None, "x"), (5, "text 5"), (5, "other"), (7000, "é" * 5000), (7001, "")]
    return spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, shard int"), rows


def test_contract(spark):
    docs, rows = frame(spark)
    got = sharding.assign(docs).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows), key=repr)
    by_shard: dict = {}
    for r in got:
        assert 0 <= r.shard < 40 and r.law == "key" and r.grown_shard in (r.shard, 40)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    moved = sum(r.grown_shard == 40 for r in got)
    assert 0.3 / 41 < moved / len(got) < 3 / 41


def test_one_more_shard_equals_an_assignment_over_more(spark):
    docs, _ = frame(spark)
    grown = {(r.doc_id, r.text_crc32): r.grown_shard for r in sharding.assign(docs).collect()}
    assert {(r.doc_id, r.text_crc32): r.shard for r in sharding.assign(docs, weights=[1.0] * 41).collect()} == grown


def test_weights(spark):
    ids = spark.range(40_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0])["shard"].alias("s"))
    n = Counter(r.s for r in ids.collect())
    assert abs(n[1] / 40_000 - 0.75) < 0.02


def test_many_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 5)
    docs, rows = frame(spark)
    by_shard: dict = {}
    for r in sharding.assign(docs).collect():
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.assign(docs.limit(0)).count() == 0


def test_winners_from_the_scores(spark):
    """The winner, worked out again from each shard's score."""
    docs = spark.createDataFrame([(k,) for k in range(300)] + [(None,)], "doc_id long")
    hashes = [F.xxhash64("doc_id", F.lit(i)).alias(f"h{i}") for i in range(6)]
    for weights in ([1.0] * 5, [1.0, 2.5, 0.5, 1.0, 4.0]):
        for r in docs.select(*hashes, sharding.rendezvous(F.col("doc_id"), weights)["shard"].alias("shard")).collect():
            scores = [-math.log(((r[f"h{i}"] % (1 << 64) >> 11) + 0.5) / (1 << 53)) / w for i, w in enumerate(weights)]
            assert scores[r.shard] == min(scores)
    for r, row in zip(docs.select("doc_id", *hashes).collect(), sharding.assign(docs.selectExpr("doc_id", "'x' AS text").filter("doc_id IS NOT NULL"), weights=[1.0] * 5).orderBy("doc_id").collect(), strict=False):
        if r.doc_id is not None:
            scores = [-math.log(((r[f"h{i}"] % (1 << 64) >> 11) + 0.5) / (1 << 53)) for i in range(6)]
            assert (r.doc_id, row.shard, row.grown_shard) == (row.doc_id, scores.index(min(scores[:5])), scores.index(min(scores)))
