"""Each stage of the pipeline against a plain version on its own input."""

import random
from collections import Counter

import pytest

from tallyrail.llm import quality

from .test_minhash import brute as near_brute
from .test_repeats import both_brute

pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input rows, output DataFrame) of each stage on the smallest tables, with extra columns of clashing names."""
    folder = tmp_path_factory.mktemp("stages")
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("*", "1 AS kept", "'x' AS rejected", "'y' AS spans", "2 AS row_", "'mine' AS host", "'own' AS host_", "3 AS row", "4 AS lines", "5 AS boilerplate", "6 AS gone", "7 AS gone_")
    out = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_columns_stay(stages):
    for _, before, after in stages[:-1]:
        assert before.columns == after.columns and before.dtypes == after.dtypes
        assert {tuple(r) for r in after.select("kept", "rejected", "spans", "row_", "host", "host_", "row", "lines", "boilerplate", "gone", "gone_").collect()} == {(1, "x", "y", 2, "mine", "own", 3, 4, 5, 6, 7)}


def test_quality(spark, stages):
    _, before, after = stages[0]
    gone = {r.doc_id for r in quality.classify(before, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).filter("rejected").collect()}
    assert texts(after) == [x for x in texts(before) if x[0] not in gone]


def test_lines(stages):
    _, before, after = stages[1]
    rows = before.select("doc_id", "source", "text").collect()
    pages, counts = Counter(r.source for r in rows), Counter()
    for r in rows:
        counts.update({(r.source, x.strip(" ")) for x in r.text.split("\n") if x.strip(" ")})
    bad = {k for k, n in counts.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    want = [(r.doc_id, "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in bad)) for r in rows]
    assert texts(after) == sorted(want, key=repr)


def test_near_duplicates(stages):
    _, before, after = stages[2]
    kept = {r[0] for r in near_brute(texts(before)) if r[3]}
    assert texts(after) == [x for x in texts(before) if x[0] in kept]


def test_repeats(stages):
    """The stage removes strings of 400 bytes and passages of 51 words; it was tested for the bytes alone before."""
    _, before, after = stages[3]
    assert dict(texts(after)) == both_brute(texts(before), 400, 51)


def test_no_passage_of_51_words_is_left_in_two_documents(stages):
    _, _, after = stages[3]
    held = {}
    for key, text in texts(after):
        words = text.split()
        for i in range(len(words) - 50):
            held.setdefault(tuple(words[i : i + 51]), set()).add(key)
    # a passage may come about by a removal between two pieces of text, so it isn't one of the input
    whole = {key: " ".join(text.split()) for key, text in texts(stages[3][1])}
    assert not [p for p, keys in held.items() if len(keys) > 1 and sum(" ".join(p) in t for t in whole.values()) > 1]


def test_repeats_of_51_short_words(spark):
    rnd = random.Random(5)
    words = lambda n: [rnd.choice("abcdefgh") + rnd.choice("abcdefgh") for _ in range(n)]
    planted, short, tails = words(51), words(50), [words(30) for _ in range(4)]
    texts_ = [
        " ".join([*tails[0], *planted, "end"]), "\n".join(["x", *planted[:20]]) + "\n" + " ".join([*planted[20:], "y", *tails[1]]),
        " ".join([*tails[2], *short]), " ".join([*short, *tails[3]]),
    ]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    got = dict(texts(pipeline.repeats(spark, docs, "")))
    assert got[0].split() == [*tails[0], "end"] and got[1].split() == ["x", "y", *tails[1]]
    assert got[2] == texts_[2] and got[3] == texts_[3]


def test_packing(stages):
    _, before, after = stages[4]
    assert {r.doc_id for r in after.select("doc_id").collect()} == {k for k, _ in texts(before)}
    fills = Counter()
    for r in after.collect():
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 2048


def test_run(spark, tmp_path):
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_empty_tables_and_nulls(spark):
    """An empty table goes through every stage; rows of nulls stay up to the last one and are packed as empty texts."""
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "some text of six words here", "en", None, 3), (10_000, None, "en", "s", None), (10_001, "", None, "s", 0)], docs.schema)
    for rows, kept in ((docs.limit(0), 0), (odd, 4)):
        for _, stage in pipeline.STAGES:
            rows = spark.createDataFrame(stage(spark, rows, small).collect(), stage(spark, rows, small).schema)
            assert rows.count() == kept
