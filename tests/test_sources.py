import json

import pytest

from tallyrail.sinks import files as sinks
from tallyrail.sinks import render
from tallyrail.sources import files


def test_selection_file_ignores_other_fields(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"note": "x", "limitless": [{"slug": "a", "end_epoch": 5, "title": "t"}], "polymarket": []}, indent=1))
    row = files.read_selection(spark, str(path)).first()
    assert row.limitless[0].slug == "a" and row.polymarket == []


def test_settings():
    assert files.read_settings('markets = ["a"]')["markets_per_shard"] == 100
    for bad in ("unknown = 1", "markets ="):
        with pytest.raises(files.SettingsError):
            files.read_settings(bad)
    files.check_flags()
    for bad in ({"workers": 9}, {"max_seconds": 14401}, {"serve": False, "min_seconds": 899}):
        with pytest.raises(files.SettingsError):
            files.check_flags(**bad)


def test_messages_keep_exact_text_and_malformed_lines(spark, tmp_path):
    good = {"connection": "c", "generation": 1, "seq": 1, "t_ns": 5, "kind": "snapshot", "events": [{"family": "f", "market": "m", "bids": [{"price": "0.10", "qty": "5"}], "asks": []}, {"family": "g", "market": "n"}]}
    (tmp_path / "m.json").write_text(json.dumps(good) + "\n{broken\n")
    events, rejected = files.decoded_messages(files.read_messages(spark, str(tmp_path / "m.json")).cache())
    assert [(r.place, r.family) for r in events.orderBy("place").collect()] == [(0, "f"), (1, "g")]
    assert events.orderBy("place").first().bids[0].price == "0.10"
    assert [r.malformed for r in rejected.collect()] == ["{broken"]


def test_snapshot_report_and_segment(spark, tmp_path):
    row = {"schema": "v", "reason": "serve_max_seconds", "qualified": False, "window_seconds": 245, "shards": [{"shard": 0, "stream": "limitless-0", "faults": {"connect_failed": 3}}]}
    sinks.write_snapshot(row, str(tmp_path / "snap.json"))
    sinks.write_snapshot(row, str(tmp_path / "snap.json"))
    sinks.write_report(row, str(tmp_path / "report.json"))
    with pytest.raises(FileExistsError):
        sinks.write_report(row, str(tmp_path / "report.json"))
    assert files.read_report(spark, str(tmp_path / "report.json")).first().faults == {"connect_failed": 3}
    books = spark.createDataFrame([(0, "a", 1), (1, "b", 1)], "shard int, market string, revision long")
    sinks.publish(books, str(tmp_path / "seg"))
    assert files.attach(spark, str(tmp_path / "seg"), "b").first().revision == 1
    with pytest.raises(files.NotInstalled):
        files.attach(spark, str(tmp_path / "seg"), "c")


def test_lines(spark):
    rows = spark.createDataFrame([("a", "accepted", None), ("b", "rejected", "unknown market")], "market string, status string, reason string")
    assert [r.line for r in render.control_answer(rows).orderBy("market").collect()] == ['{"slug":"a","status":"accepted"}', '{"slug":"b","status":{"rejected":"unknown market"}}']
    line = render.tape_lines(spark.createDataFrame([(1, "v", "v-0", "f", None, 1, 2, 3, 4, "é")], files.TAPE)).first().line
    assert json.loads(line)["market"] is None and json.loads(line)["text"] == "é"
