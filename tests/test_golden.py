"""Documented sample output as fixtures."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyrail.functions import exact
from tallyrail.operators import books, health, latency, selection, tape

# Totals, levels and lines of the documented sample output.
TAPE = [
    ("limitless", "marketCreated", 2, 2, 358), ("limitless", "marketResolved", 5, 5, 875), ("limitless", "orderbookUpdate", 4, 4, 1874), ("limitless", "system", 3, 3, 492),
    ("polymarket", "best_bid_ask", 2748, 2748, 787406), ("polymarket", "book", 2, 400, 298455), ("polymarket", "new_market", 104, 104, 264580), ("polymarket", "price_change", 6391, 6391, 3919139),
]
BIDS = [(D("0.003"), D(863898323)), (D("0.001"), D(5000000000))]
ASKS = [(D("0.899"), D(12362000)), (D("0.9"), D(91872889)), (D("0.95"), D(100000000))]
INPUT = f"market string, seq long, kind string, bids {books.LEVELS}, asks {books.LEVELS}"
BOOK = (
    "canonical_bids=[0.003@863898323,0.001@5000000000] canonical_asks=[0.899@12362000,0.9@91872889,0.95@100000000] "
    "derived_complement_bids=[0.101@12362000,0.1@91872889,0.05@100000000] derived_complement_asks=[0.997@863898323,0.999@5000000000]"
)


def test_tape_totals(spark):
    rows = []
    for venue, family, lines, events, size in TAPE:
        rows += [(venue, family, 1, 1)] * (lines - 1) + [(venue, family, events - lines + 1, size - lines + 1)]
    got = {(r.venue, r.family): (r.lines, r.events, r.bytes) for r in tape.tape_with_total(spark.createDataFrame(rows, "venue string, family string, events long, bytes long")).collect()}
    assert got.pop((None, None)) == (9259, 9657, 5273179)
    assert got == {(v, f): (n, e, b) for v, f, n, e, b in TAPE}


def test_book_replay(spark):
    rows = [("m", 0, "start", None, None), ("m", 1, "snapshot", BIDS, ASKS), ("m", 2, "disconnect", None, None), ("m", 3, "snapshot", BIDS[::-1], ASKS[::-1]), ("m", 4, "snapshot", BIDS, ASKS)]
    inputs = spark.createDataFrame(rows, INPUT)
    lines = [r.line for r in books.book_lines(books.revised(inputs)).orderBy("revision").collect()]
    empty = "canonical_bids=[] canonical_asks=[] derived_complement_bids=[] derived_complement_asks=[]"
    assert lines == [
        f"book revision=0 authority=Synchronizing continuity_epoch=0 {empty}", f"book revision=1 authority=Live continuity_epoch=0 {BOOK}", f"book revision=2 authority=Stale(Disconnect) continuity_epoch=0 {BOOK}",
        f"book revision=3 authority=Live continuity_epoch=1 {BOOK}", f"book revision=4 authority=Live continuity_epoch=1 {BOOK}",
    ]
    assert books.summary(inputs).first()[1:] == (3, 0, 1)
    assert books.bbo(books.revised(inputs)).filter("revision = 0").first()[3:] == ("-", "-")


def test_mutations_turn_the_old_book_into_the_new(spark):
    import random

    rnd = random.Random(4)
    side = lambda: [(D(p) / 1000, D(rnd.randint(1, 3))) for p in rnd.sample(range(1, 12), rnd.randint(0, 6))]
    rows = [(f"m{m}", s, "snapshot", side(), side()) for m in range(20) for s in range(6)]
    state: dict = {}
    changes = books.mutations(books.revised(spark.createDataFrame(rows, INPUT))).orderBy("market", "position").collect()
    by_seq: dict = {}
    for r in changes:
        by_seq.setdefault((r.market, r.seq), []).append(r)
    for m, s, _, bids, asks in rows:
        new = {("bid", p): q for p, q in bids} | {("ask", p): q for p, q in asks}
        if s:
            for r in by_seq.get((m, s), []):
                assert state[m].get((r.side, r.price)) == r.old_qty
                if r.new_qty is None:
                    del state[m][r.side, r.price]
                else:
                    state[m][r.side, r.price] = r.new_qty
            assert state[m] == new
        state[m] = new


def test_bucket_bounds(spark):
    rows = spark.createDataFrame([(24.333,), (43.917,), (281.167,), (129.208,), (0.0,), (999.9,), (1000.0,), (1075.709,), (10389.375,)], "us double")
    assert [r[0] for r in rows.select(exact.bucket_bound(F.col("us"))).collect()] == [25, 44, 282, 130, 1, 1000, 2000, 2000, 16000]
    report = latency.latency_report(rows.withColumns({"k": F.lit(1), "i": F.lit(1)}), "k", "us", "i").first()
    assert (report.samples, report.p50, report.p99, report.max_us) == (9, 282, 16000, 10389.375)


def test_exact_text(spark):
    rows = spark.createDataFrame([("0.10",), ("5000000000",), ("-1.5",), ("1e5",), (None,), ("0.1234567896",)], "t string").select(exact.decoded(F.col("t")).alias("x"), exact.price(F.col("t")).alias("p")).collect()
    assert [(int(r.x.coefficient), r.x.scale, r.x.text) for r in rows[:3]] == [(10, 2, "0.10"), (5000000000, 0, "5000000000"), (-15, 1, "-1.5")]
    assert rows[3].x is None and rows[4].x is None and rows[5].p is None and rows[0].p == D("0.1")


def test_byte_cut_stops_at_characters(spark):
    texts = ["a" * 599, "a" * 600, "a" * 601, "é" * 400, "a" + "é" * 400, "漢" * 300, "aa" + "🙂" * 200, "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(exact.byte_cut(F.col("t"))).collect()]
    want = [t if t is None or len(t.encode()) <= 600 else t.encode()[:600].decode("utf-8", "ignore") + "…" for t in texts]
    assert got == want


def test_selection_rules(spark):
    import pytest

    schema = "limitless array<struct<slug:string,end_epoch:bigint>>, polymarket array<struct<condition_id:string,clob_token_ids:array<string>,end_epoch:bigint>>"
    file = lambda a, b: spark.createDataFrame([(a, b)], schema)
    whole = file([("s", 2000)], [(f"c{k}", [f"x{k}", f"y{k}"], 2000) for k in range(200)])
    rows = selection.validated(whole, 1000)
    assert rows.count() == 201 and selection.targets(rows).count() == 401
    shards = {(r.venue, r.stream) for r in selection.sharded(rows).collect()}
    assert shards == {("limitless", "limitless-0"), ("polymarket", "polymarket-0"), ("polymarket", "polymarket-1")}
    assert selection.validated(file([], [("c", ["x"], 2000)]), 1000).count() == 1
    for bad in (file([], []), file(None, [("c", ["x"], 2000)]), file([("s", 1000)], []), file([("s", None)], [])):
        with pytest.raises(selection.SelectionError):
            selection.validated(bad, 1000)
    with pytest.raises(selection.SelectionError):
        selection.validated(whole, 1000, serve=False, max_seconds=800)


def test_a_missing_venue_does_not_qualify(spark):
    events = spark.createDataFrame([("limitless",)] * 20, "venue string")
    got = health.qualified(events, F.lit(1000), ["limitless", "polymarket"], 900, 10).first()
    assert not got.qualified and got.least_events == 0


def test_bounded_tape_drops_new_lines(spark):
    burst = spark.createDataFrame([("s", k, 0, 1) for k in range(10)] + [("s", 10, 50_000_000, 1)], "stream string, seq long, t_ns long, events long")
    got = tape.bounded_tape(burst, capacity=6).orderBy("seq").collect()
    assert [r.dropped for r in got] == [False] * 6 + [True] * 4 + [False]


def queue_brute(rows, capacity, per_tick, tick):
    """(seq, queued, dropped): a queue that takes a line while there is room, emptied at each tick after the first line."""
    out = []
    for stream in {r[0] for r in rows}:
        mine = sorted((r[2], r[1]) for r in rows if r[0] == stream)
        x, slot, first = 0, 0, mine[0][0]
        for at, seq in mine:
            now = (at - first) // tick
            x, slot = max(0, x - (now - slot) * per_tick), now
            full = x >= capacity
            x += not full
            out.append((seq, x, full))
    return sorted(out)


def test_bounded_tape_against_a_queue(spark):
    import random

    rnd = random.Random(8)
    assert [r[2] for r in queue_brute([("s", k, 0) for k in range(10)] + [("s", 10, 2), ("s", 11, 3)], 6, 1, 1)] == [False] * 6 + [True] * 4 + [False] * 2
    rows, at = [], 0
    for k in range(3000):
        at += rnd.choice([0, 0, 0, 1, 1, 2, 9, 400 if rnd.random() < 0.02 else 1])
        rows.append((f"s{rnd.randint(0, 2)}", k, at))
    frame = spark.createDataFrame([(*r, "x") for r in rows], "stream string, seq long, t_ns long, queued_ string")
    for capacity, per_tick, tick, block in ((6, 1, 1, 7), (3, 2, 5, 3), (50, 1, 2, 60_000)):
        got = tape.bounded_tape(frame, capacity, per_tick, tick, block)
        assert sorted((r.seq, r.queued, r.dropped) for r in got.collect()) == queue_brute(rows, capacity, per_tick, tick)
        assert got.columns == [*frame.columns, "queued", "dropped"]
    assert tape.bounded_tape(frame.limit(0)).count() == 0


def test_a_price_listed_twice(spark):
    rows = [("m", 1, "snapshot", [(D("0.1"), D(1)), (D("0.2"), D(5)), (D("0.10"), D(2))], None), ("m", 2, "snapshot", [(D("0.2"), D(5)), (D("0.1"), D(2))], []), ("m", 3, "resolved", None, None)]
    states = books.revised(spark.createDataFrame(rows, INPUT))
    first = states.orderBy("seq").first()
    assert [(x.price, x.qty) for x in first.bids] == [(D("0.2"), D(5)), (D("0.1"), D(2))]
    assert books.mutations(states).count() == 0 and states.count() == 2


def test_resolutions_keep_book_and_revision(spark):
    rows = [("m", 0, "start", None, None), ("m", 1, "snapshot", BIDS, ASKS), ("m", 2, "snapshot", BIDS[:1], ASKS), ("m", 3, "resolved", None, None), ("m", 4, "disconnect", None, None), ("m", 5, "resolved", None, None)]
    states = books.revised(spark.createDataFrame(rows, INPUT), resolutions=True)
    outcomes = spark.createDataFrame([("m", 3, "YES", 0, "final", "2026-01-01", "a/b")], "market string, seq long, outcome string, index long, type string, date string, path string")
    got = [r.line for r in books.resolution_lines(states, books.mutations(states), outcomes).orderBy("seq").collect()]
    assert got == [
        "resolution revision=2 cursor=0:1 origin=venue outcome=YES index=0 type=final date=2026-01-01 path=a/b",
        "resolution revision=3 cursor=1:0 origin=venue outcome=none index=none type=none date=none path=none",
    ]
    assert [r.authority for r in states.orderBy("seq").collect()] == ["Synchronizing", "Live", "Live", "Live", "Stale(Disconnect)", "Stale(Disconnect)"]


def test_attempts_of_the_rolling_day(spark):
    import random

    rnd = random.Random(2)
    ats = [rnd.randint(0, 400_000) for _ in range(400)] + [86_400, 86_400, 172_800, 0, 86_399, 86_401, 172_801]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ats)], "k long, at long")
    got = {r.k: (r.attempts, r.exhausted) for r in health.attempts(rows, "at", most=100).collect()}
    want = {k: sum(t - 86_400 <= x <= t for x in ats) for k, t in enumerate(ats)}
    assert got == {k: (n, n > 100) for k, n in want.items()}


def test_received_and_decoded(spark):
    rows = [("a", ["x", "y"]), ("a", []), ("a", None), ("b", ["z"] * 201)]
    got = {tuple(r) for r in health.traffic(spark.createDataFrame(rows, "connection string, events array<string>")).collect()}
    assert got == {("a", 3, 2), ("b", 1, 201)}


def test_printed_table(spark):
    from tallyrail.sinks.render import table_lines

    rows = [(v, f, n, e, b) for v, f, n, e, b in TAPE] + [(None, None, 9259, 9657, 5273179)]
    got = [r.line for r in table_lines(spark.createDataFrame(rows, "venue string, family string, lines long, events long, bytes long"), "tape at end of input").orderBy("position").collect()]
    assert got[:2] == ["tape at end of input: lines=9259 events=9657 bytes=5273179", "  limitless  marketCreated        lines=2       events=2        bytes=358"]
    assert got[-1] == "  polymarket price_change         lines=6391    events=6391     bytes=3919139"
