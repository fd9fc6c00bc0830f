import json
import os

import pytest

from tallyrail.functions.exact import PRICE, QUANTITY
from tallyrail.operators import books as batch
from tallyrail.sources import files
from tallyrail.sources.replay import ReplaySource
from tallyrail.operators import health as batch_health
from tallyrail.streaming import books, health, publish, tape

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

LINES = [{"t_ns": k * 2_500_000_000, "venue": "v", "stream": "v-0", "family": "ab"[k % 2], "market": "m", "events": 1, "bytes": k, "handoff_ns": 1, "generation": 1, "text": "x"} for k in range(40)]


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def write(folder, rows, parts):
    """Files whose times tell their order, by which a file stream reads them."""
    for k in range(parts):
        path = folder / f"{k:03d}.json"
        path.write_text("".join(json.dumps(r) + "\n" for r in rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]))
        os.utime(path, (1_700_000_000 + 5 * k,) * 2)


def test_tape_windows_match_the_batch_table(spark, tmp_path):
    write(tmp_path, LINES, 4)
    stream = files.stream_tape(spark, str(tmp_path))
    total = {(r.family, r.lines, r.bytes) for r in run(tape.since_start(stream), "since", "complete").collect()}
    assert total == {("a", 20, sum(range(0, 40, 2))), ("b", 20, sum(range(1, 40, 2)))}
    slots = run(tape.windows(stream), "slots").collect()
    assert sum(r.lines for r in slots) == 36  # the last 10 s wait for a later line


def test_replay_source(spark, tmp_path):
    (tmp_path / "t.json").write_text("".join(json.dumps(r) + "\n" for r in LINES))
    spark.dataSource.register(ReplaySource)
    stream = spark.readStream.format("replay_tape").option("path", str(tmp_path / "t.json")).option("rows", 100).load()
    assert run(tape.since_start(stream), "replayed", "complete").agg({"lines": "sum"}).first()[0] == 40


def test_book_stream_matches_the_batch_engine(spark, tmp_path):
    pytest.importorskip("pandas")
    spark.conf.set(*ROCKS)
    levels = lambda k, base: [{"price": f"0.{base + k % 3}" + "0" * (k % 2), "qty": str(k % 4 + 1)}, {"price": f"0.{base + 3}", "qty": "7"}]
    rows = []
    for m in ("x", "y"):
        for k in range(24):
            kind = "start" if k == 0 else "disconnect" if k % 9 == 4 else "snapshot"
            rows.append({"market": m, "seq": k, "generation": 1 + k // 9, "kind": kind, "bids": levels(k, 1) if kind == "snapshot" else None, "asks": levels(k, 5) if kind == "snapshot" else None})
    rows.sort(key=lambda r: r["seq"])
    rows.append({"market": "x", "seq": 30, "generation": 1, "kind": "snapshot", "bids": [], "asks": []})
    write(tmp_path, rows, 5)
    outside = tmp_path.parent / f"{tmp_path.name}-out"
    schema = "market string, seq long, generation long, kind string, bids array<struct<price:string,qty:string>>, asks array<struct<price:string,qty:string>>"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    got = run(books.book_stream(stream), "book_states").collect()
    assert [(r.market, r.seq) for r in got if r.what == "fenced"] == [("x", 30)]

    typed = spark.createDataFrame([(r["market"], r["seq"], r["kind"], r["bids"], r["asks"]) for r in rows[:-1]], "market string, seq long, kind string, bids array<struct<price:string,qty:string>>, asks array<struct<price:string,qty:string>>")
    cast = lambda c: f"transform({c}, x -> struct(cast(x.price as {PRICE}) as price, cast(x.qty as {QUANTITY}) as qty)) as {c}"
    states = batch.revised(typed.selectExpr("market", "seq", "kind", cast("bids"), cast("asks")))
    want = {(r.market, r.seq, r.revision, r.authority, r.continuity_epoch) for r in states.collect()}
    assert {(r.market, r.seq, r.revision, r.authority, r.continuity_epoch) for r in got if r.what == "state"} == want
    moves = {(r.market, r.seq, r.side, float(r.price), r.old_qty and int(r.old_qty), r.new_qty and int(r.new_qty), r.position) for r in batch.mutations(states).collect()}
    assert {(r.market, r.seq, r.side, float(r.price), r.old_qty and int(r.old_qty), r.new_qty and int(r.new_qty), r.position) for r in got if r.what == "mutation"} == moves


    q = publish.publishing(books.book_stream(stream), f"{outside}/segment", 2).option("checkpointLocation", f"{outside}/offsets").start()
    q.processAllAvailable()
    q.stop()
    published = spark.read.parquet(f"{outside}/segment/states").collect()
    assert {(r.market, r.seq, r.revision, r.authority, r.continuity_epoch) for r in published} == want and len(published) == len(want)
    assert spark.read.parquet(f"{outside}/segment/mutations").count() == len(moves)


def test_summary_is_rewritten(spark, tmp_path):
    write(tmp_path, LINES, 2)
    q = publish.summarising(tape.since_start(files.stream_tape(spark, str(tmp_path))), f"{tmp_path.parent}/out.summary", 1).start()
    q.processAllAvailable()
    q.stop()
    got = json.loads((tmp_path.parent / "out.summary").read_text())
    assert [(r["family"], r["lines"]) for r in got["rows"]] == [("a", 20), ("b", 20)]


def test_fence_and_readiness_match_the_batch_operators(spark, tmp_path):
    spark.conf.set(*ROCKS)
    rows = [{"connection": f"c{k % 2}", "seq": k, "generation": (k // 7) % 4, "run": f"r{k % 3}", "at": 2 * k, "ok": (k // 3) % 9 != 4} for k in range(90)]
    write(tmp_path, rows, 5)
    schema = "connection string, seq long, generation long, run string, at long, ok boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    whole = spark.read.schema(schema).json(str(tmp_path))
    want = {(r.seq, r.stale) for r in batch_health.fenced(whole, "connection", "seq", "generation").collect()}
    assert {(r.seq, r.stale) for r in run(health.fence_stream(stream), "fence").collect()} == want and any(stale for _, stale in want)
    for ready, timeout in ((30, 90), (30, None), (60, 70), (12, 90)):
        want = {tuple(r) for r in batch_health.readiness(whole, "run", "at", "ok", ready, timeout).filter("opened IS NOT NULL").collect()}
        assert {tuple(r) for r in run(health.readiness_stream(stream, ready, timeout), f"ready{ready}{timeout}").collect()} == want
