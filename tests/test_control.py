import pytest

from tallyrail import control
from tallyrail.sources.files import SettingsError
from tallyrail.sources.consumer import Consumer, ContinuityLost


def markets(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "market string")


def test_engine(spark):
    engine = control.Engine(markets(spark, "a"), markets(spark, "a", "b", "c"), queue=2)
    answers, code = engine.add(markets(spark, "b", "x"))
    assert code == control.REJECTED and {(r.market, r.status) for r in answers.collect()} == {("b", "accepted"), ("x", "rejected")}
    assert engine.add(markets(spark, "a", "b", "c")) == (None, control.FULL)
    assert engine.remove(markets(spark, "a"))[1] == control.APPLIED
    assert {r.market for r in engine.desired.collect()} == {"b"}
    books = spark.createDataFrame([("b", 1, "Live", 0), ("b", 2, "Stale(Disconnect)", 0)], "market string, revision long, authority string, continuity_epoch long")
    leases = spark.createDataFrame([("b", "s1"), ("b", "s1"), ("b", "s2")], "market string, session string")
    got = {r.market: r for r in engine.status(markets(spark, "a"), markets(spark, "b"), leases, books).collect()}
    assert tuple(got["b"])[1:] == ("subscribing", "stale(disconnect)", True, 2, 2, "Stale(Disconnect)", 0) and got["a"].subscription == "removing"


def test_exit_codes(spark):
    shards = spark.createDataFrame([(0, True), (1, False)], "shard int, running boolean")
    assert control.exit_code() == control.exit_code(shards=shards.filter("running")) == control.STOPPED
    assert control.exit_code(OSError("socket in use")) == control.STARTUP_FAILED
    assert control.exit_code(SettingsError("x")) == control.BAD_SETTINGS
    assert control.exit_code(shards=shards) == control.exit_code(OSError("gone"), shards) == control.SHARD_STOPPED


def test_consumer(spark, tmp_path):
    states, moves = str(tmp_path / "states"), str(tmp_path / "moves")

    def publish(revision, epoch, positions):
        spark.createDataFrame([("m", revision, epoch)], "market string, revision long, continuity_epoch long").write.mode("append").parquet(states)
        spark.createDataFrame([("m", revision, epoch, p) for p in positions], "market string, revision long, continuity_epoch long, position long").write.mode("append").parquet(moves)

    publish(1, 0, [1, 2])
    reader = Consumer(spark, states, moves, "m", capacity=3)
    assert reader.state.revision == 1 and reader.next_event() is None
    publish(2, 0, [3, 4])
    assert [reader.next_event().position for _ in range(2)] == [3, 4] and reader.next_event() is None
    publish(3, 0, range(5, 9))
    for _ in range(2):
        with pytest.raises(ContinuityLost, match="Overrun"):
            reader.next_event()
    assert reader.reattach().revision == 3 and reader.next_event() is None
    publish(4, 1, [1])
    with pytest.raises(ContinuityLost, match="Reconnect"):
        reader.next_event()
    assert reader.reattach().continuity_epoch == 1
