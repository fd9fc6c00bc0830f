"""Every operator applied to the test tables, and the same in DuckDB's SQL.

The tables hold no feeds, so ``events`` stands in for one: user_id is the market, event_type the family, value the
latency in microseconds, event_id the sequence number and props the payload.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from ..operators import books, health, latency, routing, selection, tape

#: Parameters of the stand-in.
NOW, DAY = 1_704_067_200, 86_400
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def feed(spark: SparkSession, d: str) -> DataFrame:
    """events as a tape: one event a message."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("seq"), "ts", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t_ns"),
        F.when(F.col("event_type").isin("view", "click"), "first").otherwise("second").alias("venue"),
        F.concat(F.lit("s-"), (F.col("user_id") % 3).cast("string")).alias("stream"), F.col("event_type").alias("family"), F.col("user_id").alias("market"),
        F.lit(1).cast("long").alias("events"), F.octet_length("props").cast("long").alias("bytes"), F.floor(F.col("value")).alias("generation"), "value", "props",
    )


FEED = """feed AS (SELECT event_id AS seq, ts, epoch_us(ts) * 1000 AS t_ns,
  CASE WHEN event_type IN ('view', 'click') THEN 'first' ELSE 'second' END AS venue, 's-' || (user_id % 3) AS stream,
  event_type AS family, user_id AS market, 1::BIGINT AS events, strlen(props)::BIGINT AS bytes,
  floor(value)::BIGINT AS generation, value, props FROM events)"""
COUNTS = "count(*) AS lines, sum(events)::BIGINT AS events, sum(bytes)::BIGINT AS bytes"


@query(f"WITH {FEED} SELECT date_trunc('hour', ts) AS hour, family, {COUNTS} FROM feed GROUP BY ALL")
def tape_hourly(spark, d):
    return tape.tape_table(feed(spark, d).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")), "hour", "family")


@query(f"WITH {FEED} SELECT venue, family, {COUNTS} FROM feed GROUP BY GROUPING SETS ((venue, family), ())")
def tape_since_start(spark, d):
    return tape.tape_with_total(feed(spark, d))


@query(f"""WITH {FEED} SELECT (t_ns - (SELECT min(t_ns) FROM feed)) // 3600000000000 AS slot, venue, family, {COUNTS} FROM feed GROUP BY ALL""")
def tape_intervals(spark, d):
    return tape.tape_intervals(feed(spark, d), 3600, "venue", "family")


@query("""SELECT event_id // 5 AS batch, arg_min(event_type, event_id) AS family, arg_min(user_id, event_id) AS market, count(*) AS n_events FROM events GROUP BY 1""")
def batch_labels(spark, d):
    e = table(spark, d, "events").withColumn("batch", F.floor(F.col("event_id") / 5))
    messages = e.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("family"), F.col("user_id").alias("market")))).alias("events"))
    return tape.labelled(messages).select("batch", "family", "market", "n_events")


@query(f"WITH {FEED} SELECT seq, family, bytes FROM feed WHERE market = 7")
def tape_follow(spark, d):
    return tape.follow(feed(spark, d), 7).select("seq", "family", "bytes")


@query(f"""WITH {FEED} SELECT family, count(*) AS n FROM feed
WHERE t_ns >= {(NOW + 5 * DAY) * 10**9} AND t_ns < {(NOW + 9 * DAY) * 10**9} GROUP BY family""")
def window_gate(spark, d):
    return tape.window_gate(feed(spark, d), F.lit((NOW + 5 * DAY) * 10**9), F.lit((NOW + 9 * DAY) * 10**9)).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CASE WHEN strlen(text) <= 600 THEN text ELSE left(text, list_max(list_filter(range(0, 601),
  lambda k: strlen(left(text, k)) <= 600))::INT) || '…' END AS text FROM documents""")
def text_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", exact.byte_cut(F.col("text")).alias("text"))


TEXT = "CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR)"


@query(f"""SELECT event_id, CAST(replace({TEXT}, '.', '') AS BIGINT) AS coefficient, 2 AS scale, {TEXT} AS text FROM events""")
def exact_decimals(spark, d):
    e = table(spark, d, "events").select("event_id", exact.decoded(F.col("value").cast("decimal(10,2)").cast("string")).alias("x"))
    return e.select("event_id", F.col("x.coefficient").cast("long").alias("coefficient"), "x.scale", "x.text")


@query("""SELECT event_id, rtrim(rtrim(CAST(1 - CAST(CAST(value AS DECIMAL(10,2)) / 1000 AS DECIMAL(18,9)) AS VARCHAR), '0'), '.') AS complement FROM events""")
def complement_prices(spark, d):
    p = exact.price((F.col("value").cast("decimal(10,2)") / 1000).cast("decimal(18,9)").cast("string"))
    levels = F.array(F.struct(p.alias("price"), F.lit(1).cast("decimal(38,0)").alias("qty")))
    return table(spark, d, "events").select("event_id", exact.rendered(exact.complement(levels)[0]["price"]).alias("complement"))


def level_rows(spark, d):
    """Each market's bids and asks of a day as level lists in arrival order."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("view", "click"))
    level = F.struct("event_id", (F.col("value").cast("decimal(10,2)") / 1000).cast("decimal(18,9)").alias("price"), F.col("event_id").cast("decimal(38,0)").alias("qty"))
    side = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, level))), lambda x: F.struct(x["price"], x["qty"]))
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(side("view").alias("bids"), side("click").alias("asks"))


P = "rtrim(rtrim(CAST(CAST(CAST(value AS DECIMAL(10,2)) / 1000 AS DECIMAL(18,9)) AS VARCHAR), '0'), '.')"


@query(f"""WITH l AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, event_id, CAST(value AS DECIMAL(10,2)) AS v, {P} || '@' || event_id AS t
  FROM events WHERE event_type IN ('view', 'click'))
SELECT user_id, day, coalesce(arg_min(t, event_id) FILTER (event_type = 'view'), '-') AS first_bid, coalesce(arg_min(t, event_id) FILTER (event_type = 'click'), '-') AS first_ask,
  coalesce(arg_max(t, (v, event_id)) FILTER (event_type = 'view'), '-') AS best_bid, coalesce(arg_min(t, (v, event_id)) FILTER (event_type = 'click'), '-') AS best_ask
FROM l GROUP BY ALL""")
def best_levels(spark, d):
    """What the venue listed first, and the best of the book."""
    rows = level_rows(spark, d)
    return rows.select(
        "user_id", "day", exact.level_text(F.get("bids", 0)).alias("first_bid"), exact.level_text(F.get("asks", 0)).alias("first_ask"),
        exact.level_text(exact.best(F.col("bids"), True)).alias("best_bid"), exact.level_text(exact.best(F.col("asks"), False)).alias("best_ask"),
    )


@query(f"""WITH l AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, CAST(value AS DECIMAL(10,2)) AS v, {P} || '@' || event_id AS t FROM events WHERE event_type = 'view'),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY v DESC, event_id DESC) AS k FROM l)
SELECT user_id, day, '[' || string_agg(t, ',' ORDER BY k) || ']' AS side FROM r WHERE k <= 3 GROUP BY ALL""")
def printed_levels(spark, d):
    rows = level_rows(spark, d).filter(F.size("bids") > 0)
    return rows.select("user_id", "day", exact.side_text(exact.levels_sorted(F.col("bids"), True)).alias("side"))


UB = "CASE WHEN us < 1000 THEN floor(us)::BIGINT + 1 ELSE (1000 * 2 ** ceil(log2(floor(us / 1000 + 1e-9)::BIGINT + 1)))::BIGINT END"


@query(f"""WITH s AS (SELECT event_type AS family, event_id, value * 8 AS us FROM events), h AS (SELECT family, {UB} AS ub, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT family, ub, sum(n) OVER (PARTITION BY family ORDER BY ub) AS cum, sum(n) OVER (PARTITION BY family) AS total FROM h)
SELECT family, max(total)::BIGINT AS samples, min(ub) FILTER (cum * 1000 >= total * 500) AS p50, min(ub) FILTER (cum * 1000 >= total * 990) AS p99,
  min(ub) FILTER (cum * 1000 >= total * 999) AS p999, any_value(m.max_us) AS max_us, any_value(m.last_us) AS last_us
FROM c JOIN (SELECT family, max(us) AS max_us, arg_max(us, event_id) AS last_us FROM s GROUP BY family) m USING (family) GROUP BY family""")
def latency_bounds(spark, d):
    s = table(spark, d, "events").select(F.col("event_type").alias("family"), "event_id", (F.col("value") * 8).alias("us"))
    return latency.latency_report(s, "family", "us", "event_id")


def chosen(spark, d):
    """Orders as a selection: the customer is the event, the order the market."""
    o = table(spark, d, "orders")
    end = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return o.select(F.when(F.col("o_orderkey") % 3 == 0, "limitless").otherwise("polymarket").alias("venue"), F.col("o_orderkey").alias("position"), F.col("o_orderkey").alias("market"), F.col("o_custkey").alias("event"), end.alias("end_epoch"), F.when(F.col("o_orderkey") % 3 != 0, F.array(F.concat(F.lit("a"), "o_orderkey"), F.concat(F.lit("b"), "o_orderkey"))).alias("tokens"))


CHOSEN = """chosen AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'limitless' ELSE 'polymarket' END AS venue, o_orderkey AS position, o_orderkey AS market,
  o_custkey AS event, epoch(o_orderdate)::BIGINT AS end_epoch, CASE WHEN o_orderkey % 3 <> 0 THEN ['a' || o_orderkey, 'b' || o_orderkey] END AS tokens FROM orders)"""
MID = 852_076_800  # 1 January 1997


@query(f"WITH {CHOSEN} SELECT venue, market, unnest(coalesce(tokens, [NULL])) AS asset FROM chosen")
def selection_targets(spark, d):
    return selection.targets(chosen(spark, d))


@query(f"""WITH {CHOSEN} SELECT market, (row_number() OVER (PARTITION BY venue ORDER BY position) - 1) // 100 AS shard,
  venue || '-' || ((row_number() OVER (PARTITION BY venue ORDER BY position) - 1) // 100) AS stream FROM chosen""")
def selection_shards(spark, d):
    return selection.sharded(chosen(spark, d)).select("market", "shard", "stream")


@query(f"""WITH {CHOSEN} SELECT count(*) FILTER (end_epoch <= {MID}) AS expired, count(*) FILTER (end_epoch < {MID} + 14400 + 210) AS too_short,
  count(*) FILTER (end_epoch > {MID} + 3600) AS pruned, count(*) FILTER (end_epoch >= {MID} + 5 * 86400) AS lasting, min(end_epoch) AS valid_until FROM chosen""")
def selection_expiry(spark, d):
    rows = chosen(spark, d)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(selection.expired(rows, MID), "expired")
    for other in (n(selection.expired(rows, MID, False, 14_400), "too_short"), n(selection.pruned(rows, MID), "pruned"), n(selection.lasting(rows, MID), "lasting"), selection.valid_until(rows)):
        out = out.crossJoin(F.broadcast(other))  # one row each
    return out


@query(f"""WITH {CHOSEN}, r AS (SELECT event, market, end_epoch, row_number() OVER (PARTITION BY event ORDER BY end_epoch, market) AS k FROM chosen)
SELECT event, market, end_epoch FROM r WHERE k <= 4""")
def selection_per_event(spark, d):
    return selection.per_event(chosen(spark, d), "event").select("event", "market", "end_epoch")


@query(f"WITH {CHOSEN} SELECT market, end_epoch FROM chosen ORDER BY (end_epoch < {MID})::INT, end_epoch, market LIMIT 200")
def selection_upcoming(spark, d):
    return selection.upcoming(chosen(spark, d), MID, "end_epoch", 200).select("market", "end_epoch")


@query(f"""WITH {CHOSEN} SELECT venue, market FROM chosen WHERE venue <> 'limitless'
UNION ALL SELECT 'limitless', s_suppkey FROM supplier""")
def selection_merge(spark, d):
    other = table(spark, d, "supplier").select(F.lit("limitless").alias("venue"), F.col("s_suppkey").alias("market"))
    return selection.merged(chosen(spark, d).select("venue", "market"), other)


def sets(spark, d):
    """Desired: customers of the first segment in the alphabet and all who buy; asked: all who look; known: customers."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("market"), "c_mktsegment")
    e = table(spark, d, "events").select(F.col("user_id").alias("market"), "event_type")
    desired = c.filter("c_mktsegment = 'AUTOMOBILE'").select("market").union(e.filter("event_type = 'purchase'").select("market"))
    return desired, e.filter("event_type = 'view'").select("market"), c.select("market")


DESIRED = "SELECT c_custkey AS market FROM customer WHERE c_mktsegment = 'AUTOMOBILE' UNION SELECT user_id FROM events WHERE event_type = 'purchase'"
ASKED = "SELECT user_id AS market FROM events WHERE event_type = 'view'"


@query(f"{DESIRED} UNION {ASKED}")
def set_add(spark, d):
    desired, asked, _ = sets(spark, d)
    return selection.added(desired, asked)


@query(f"({DESIRED}) EXCEPT ({ASKED})")
def set_remove(spark, d):
    desired, asked, _ = sets(spark, d)
    return selection.removed(desired, asked)


@query(f"""WITH d AS ({DESIRED}) SELECT DISTINCT market, CASE WHEN market IN (SELECT market FROM d) THEN 'removed' ELSE 'rejected' END AS status,
  CASE WHEN market IN (SELECT market FROM d) THEN NULL ELSE 'not desired' END AS reason FROM ({ASKED})""")
def set_answers(spark, d):
    desired, asked, known = sets(spark, d)
    return selection.answers(desired, asked, known, add=False)


@query(f"WITH {FEED} SELECT seq, market, c_name FROM feed JOIN customer ON market = c_custkey")
def route_events(spark, d):
    targets = table(spark, d, "customer").select(F.col("c_custkey").alias("market"), "c_name")
    return routing.routed(feed(spark, d), targets, ["market"]).select("seq", "market", "c_name")


@query(f"WITH {FEED} SELECT family, count(*) AS unrouted FROM feed WHERE market NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY family")
def unrouted_events(spark, d):
    targets = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("market"))
    return routing.unrouted(feed(spark, d), targets, ["market"]).groupBy("family").agg(F.count(F.lit(1)).alias("unrouted"))


@query("SELECT c_custkey AS market FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def installed_markets(spark, d):
    return routing.installed(table(spark, d, "customer").select(F.col("c_custkey").alias("market")), table(spark, d, "events").select(F.col("user_id").alias("market")))


@query("""SELECT c_nationkey AS connection, count(*) FILTER (c_custkey IN (SELECT user_id FROM events WHERE event_type = 'signup')) AS covered, count(*) AS required FROM customer GROUP BY ALL""")
def target_coverage(spark, d):
    targets = table(spark, d, "customer").select(F.col("c_custkey").alias("market"), F.col("c_nationkey").alias("connection"))
    evidence = table(spark, d, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("market"))
    return routing.coverage(targets, evidence, ["market"], "connection")


@query("""SELECT c_custkey AS market, c_mktsegment AS subscription, c_custkey % 5 = 0 AS pinned, coalesce(n, 0)::BIGINT AS leases FROM customer
LEFT JOIN (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1) ON user_id = c_custkey""")
def market_status(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("market"), F.col("c_mktsegment").alias("subscription"))
    leases = table(spark, d, "events").select(F.col("user_id").alias("market"), F.col("event_type").alias("session"))
    return routing.market_status(c, c.filter("market % 5 = 0"), leases)


@query("""WITH a AS (SELECT DISTINCT user_id AS market FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id AS market FROM events WHERE value > 200)
SELECT coalesce(a.market, b.market) AS market, CASE WHEN b.market IS NULL THEN 'subscribing' WHEN a.market IS NULL THEN 'removing' ELSE 'established' END AS subscription
FROM a FULL OUTER JOIN b ON a.market = b.market""")
def reconcile_sets(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "market")
    return routing.reconciled(e.filter("event_type = 'view'"), e.filter("value > 200"))


@query("""SELECT user_id AS connection, sum(n)::BIGINT AS faults, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS counters
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def fault_counters(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "connection")
    rows = health.counter_map(e, "connection", "event_type")
    return rows.select("connection", health.fault_total(F.col("counters")).alias("faults"), F.to_json("counters").alias("counters"))


@query(f"WITH {FEED} SELECT count(*) FILTER (family = 'view') AS first_venue, count(*) FILTER (family IN ('click', 'purchase')) AS second_venue FROM feed")
def feed_activity(spark, d):
    return health.activity(feed(spark, d), "view", ("click", "purchase"))


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'signup') > 0 AS up, count(*) FILTER (event_type = 'view') > 0 AS subscribed, max(value) > 100 AS heartbeat,
  count(*) FILTER (event_type = 'click') AS acked, 3 AS required FROM events GROUP BY 1)
SELECT count(*) FILTER (up AND subscribed AND heartbeat AND acked >= required) AS healthy, count(*) AS connections FROM c""")
def healthy_connections(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "connection")
    kind = lambda x: F.count_if(F.col("event_type") == x) > 0
    c = e.groupBy("connection").agg(kind("signup").alias("up"), kind("view").alias("subscribed"), F.lit(True).alias("acknowledges"), F.lit(3).alias("required"))
    acks = e.filter("event_type = 'click'").select("connection", F.col("event_id").alias("market"))
    return health.healthy(health.with_evidence(c, e.filter("value > 100"), acks), serve=False)


@query(f"""WITH {FEED}, f AS (SELECT *, generation < max(generation) OVER (PARTITION BY market ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stale FROM feed)
SELECT market, count(*) FILTER (stale) AS fenced, count(*) FILTER (NOT stale) AS admitted FROM f GROUP BY market""")
def generation_fence(spark, d):
    rows = health.fenced(feed(spark, d), "market", "seq", "generation")
    return rows.groupBy("market").agg(F.count_if("stale").alias("fenced"), F.count_if(~F.col("stale")).alias("admitted"))


@query(f"""WITH {FEED}, f AS (SELECT stream, generation - lag(generation) OVER (PARTITION BY stream ORDER BY seq) AS step FROM feed)
SELECT stream, count(*) FILTER (step > 1) AS gaps, count(*) FILTER (step = 0) AS repeats, count(*) FILTER (step < 0) AS backs FROM f GROUP BY stream""")
def sequence_faults(spark, d):
    return health.sequence_faults(feed(spark, d), "stream", "seq", "generation")


@query("""WITH h AS (SELECT user_id AS run, epoch(ts)::BIGINT AS s, event_type <> 'error' AS ok, event_id FROM events),
g AS (SELECT run, s, bool_and(ok) AS ok FROM (SELECT run, floor(epoch(ts))::BIGINT AS s, event_type <> 'error' AS ok FROM (SELECT user_id AS run, * FROM events)) GROUP BY ALL),
i AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY run ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM g),
p AS (SELECT run, min(s) AS since, max(s) AS until FROM i WHERE ok GROUP BY run, island),
r AS (SELECT run, min(since) + 21600 AS ready_at FROM p WHERE until - since >= 21600 GROUP BY run),
t AS (SELECT run, min(s) + 400000 AS late FROM g GROUP BY run)
SELECT run, least(ready_at, late) AS opened, CASE WHEN ready_at <= late THEN 'readiness' ELSE 'timeout' END AS "by" FROM t LEFT JOIN r USING (run)""")
def readiness(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), (F.col("event_type") != "error").alias("ok"))
    rows = e.groupBy("run", "s").agg(F.bool_and("ok").alias("ok"))
    return health.readiness(rows, "run", "s", "ok", 21_600, 400_000)


@query(f"""WITH {FEED}, t AS (SELECT ((max(t_ns) - min(t_ns)) // 1000000000)::BIGINT AS seconds, count(*) FILTER (venue = 'first') AS a, count(*) FILTER (venue = 'second') AS b FROM feed)
SELECT seconds, least(a, b) AS least_events, seconds >= 900 AND a >= 100 AND b >= 100 AS qualified FROM t""")
def qualification(spark, d):
    seconds = F.expr("(max(t_ns) - min(t_ns)) div 1000000000")
    return health.qualified(feed(spark, d), seconds, ["first", "second"], 900, 100)


@query("""WITH r AS (SELECT user_id AS run, bool_or(value > 300) AS serve, CASE WHEN user_id % 7 = 0 THEN 'INT' WHEN user_id % 11 = 0 THEN 'TERM' END AS signal,
  count(*) FILTER (event_type = 'purchase' AND value > 150) > 0 AS resolved, count(*) FILTER (event_type = 'error' AND value > 120) AS faults, count(*) > 40 AS floors_met, max(value) > 320 AS timed_out FROM events GROUP BY 1)
SELECT run, CASE WHEN signal = 'INT' THEN 'operator_interrupt' WHEN signal = 'TERM' THEN 'operator_terminate' WHEN resolved THEN 'selected_target_resolved'
  WHEN NOT serve AND faults > 0 THEN 'fault' WHEN NOT serve AND floors_met THEN 'healthy_floors_reached' WHEN serve AND timed_out THEN 'serve_max_seconds' ELSE 'insufficient_samples' END AS reason,
  CASE WHEN serve AND signal IS NOT NULL THEN 0 WHEN NOT serve AND signal IS NULL AND faults = 0 AND floors_met THEN 0 ELSE 2 END AS exit_code FROM r""")
def run_outcome(spark, d):
    u, v, kind = F.col("user_id"), F.col("value"), F.col("event_type")
    runs = table(spark, d, "events").groupBy(u.alias("run")).agg(
        F.bool_or(v > 300).alias("serve"), (F.count_if((kind == "purchase") & (v > 150)) > 0).alias("resolved"), F.count_if((kind == "error") & (v > 120)).alias("faults"),
        (F.count(F.lit(1)) > 40).alias("floors_met"), (F.max("value") > 320).alias("timed_out"),
    ).withColumn("signal", F.when(F.col("run") % 7 == 0, "INT").when(F.col("run") % 11 == 0, "TERM"))
    return health.outcome(runs).select("run", "reason", "exit_code")


@query("""SELECT event_id, count(*) OVER w AS attempts, count(*) OVER w > 280 AS exhausted
FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)
WINDOW w AS (ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""")
def attempt_budget(spark, d):
    rows = table(spark, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return health.attempts(rows, "at").select("event_id", "attempts", "exhausted")


def book_inputs(spark, d):
    """Each event is a snapshot of two bids and one ask that depend on it; every signup is a disconnect."""
    e = table(spark, d, "events")
    level = lambda p, q: F.struct((p.cast("int") / 10).cast(exact.PRICE).alias("price"), q.cast(exact.QUANTITY).alias("qty"))
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("market"), i.alias("seq"), F.when(F.col("event_type") == "signup", "disconnect").otherwise("snapshot").alias("kind"),
        F.array(level(i % 3 + 1, i % 2 + 5), level(i % 2 + 5, F.lit(7))).alias("bids"), F.array(level(i % 2 + 8, i % 5 + 1)).alias("asks"),
    )


BOOKS = """books AS (SELECT user_id AS market, event_id AS seq, event_type = 'signup' AS loss,
  count(*) OVER w AS revision, CASE WHEN event_type = 'signup' THEN 'Stale(Disconnect)' ELSE 'Live' END AS authority,
  (sum((event_type = 'signup')::INT) OVER w - (event_type = 'signup')::INT)::BIGINT AS continuity_epoch,
  max(event_id) FILTER (event_type <> 'signup') OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))"""


@query(f"""WITH {BOOKS} SELECT market, revision, authority, continuity_epoch, coalesce('0.' || (i % 2 + 5) || '@7', '-') AS best_bid,
  coalesce('0.' || (i % 2 + 8) || '@' || (i % 5 + 1), '-') AS best_ask FROM books""")
def book_revisions(spark, d):
    return books.bbo(books.revised(book_inputs(spark, d)), "continuity_epoch")


LEVELS = f"""{BOOKS}, live AS (SELECT market, seq, revision, continuity_epoch FROM books WHERE NOT loss),
pairs AS (SELECT *, lag(seq) OVER (PARTITION BY market, continuity_epoch ORDER BY seq) AS before FROM live),
level AS (SELECT unnest([{{'side': 'bid', 'p': i % 3 + 1, 'q': i % 2 + 5}}, {{'side': 'bid', 'p': i % 2 + 5, 'q': 7}}, {{'side': 'ask', 'p': i % 2 + 8, 'q': i % 5 + 1}}]) AS l, i FROM (SELECT event_id AS i FROM events)),
flat AS (SELECT i, l.side AS side, l.p AS p, l.q AS q FROM level),
old AS (SELECT market, pairs.seq, revision, continuity_epoch, side, p, q FROM pairs JOIN flat ON i = before),
new AS (SELECT market, pairs.seq, revision, continuity_epoch, side, p, q FROM pairs JOIN flat ON i = pairs.seq WHERE before IS NOT NULL),
diff AS (SELECT market, seq, revision, continuity_epoch, side, p, old.q AS old_q, new.q AS new_q FROM old FULL OUTER JOIN new USING (market, seq, revision, continuity_epoch, side, p)
  WHERE old.q IS DISTINCT FROM new.q)"""


@query(f"""WITH {LEVELS} SELECT market, revision, side, '0.' || p AS price, coalesce(old_q::VARCHAR, 'none') AS old_qty, coalesce(new_q::VARCHAR, 'none') AS new_qty,
  continuity_epoch || ':' || row_number() OVER (PARTITION BY market, continuity_epoch ORDER BY seq, side, p) AS "cursor" FROM diff""")
def book_mutations(spark, d):
    rows = books.mutations(books.revised(book_inputs(spark, d)))
    return rows.select("market", "revision", "side", exact.rendered(F.col("price")).alias("price"), *[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in ("old_qty", "new_qty")], "cursor")


@query(f"""WITH {LEVELS} SELECT market, count(*) FILTER (NOT loss) AS snapshots_applied, coalesce(any_value(n), 0)::BIGINT AS mutations_derived, count(*) FILTER (loss) AS continuity_losses
FROM books LEFT JOIN (SELECT market, count(*) AS n FROM diff GROUP BY 1) USING (market) GROUP BY market""")
def book_summary(spark, d):
    return books.summary(book_inputs(spark, d))


@query(f"""WITH {LEVELS}, head AS (SELECT market, continuity_epoch, count(*) AS head FROM diff GROUP BY ALL)
SELECT c_custkey AS market, c_nationkey::BIGINT AS position, head, CASE WHEN c_nationkey < head - 16 THEN 'Overrun' END AS reason
FROM customer LEFT JOIN (SELECT * FROM head WHERE continuity_epoch = 0) ON market = c_custkey""")
def reader_overrun(spark, d):
    """A reader for each customer, in the first epoch, at the position of its nation's number."""
    heads = books.heads(books.mutations(books.revised(book_inputs(spark, d))))
    readers = table(spark, d, "customer").select(F.col("c_custkey").alias("market"), F.lit(0).cast("long").alias("continuity_epoch"), F.col("c_nationkey").cast("long").alias("position"))
    return books.overrun(heads, readers, 16).select("market", "position", "head", "reason")


@query(f"""WITH {BOOKS}, b AS (SELECT market, revision, authority, continuity_epoch AS e, i, i % 3 + 1 AS p1, i % 2 + 5 AS q1, i % 2 + 5 AS p2, i % 2 + 8 AS pa, i % 5 + 1 AS qa FROM books)
SELECT market, revision, 'book revision=' || revision || ' authority=' || authority || ' continuity_epoch=' || e ||
  ' canonical_bids=[' || coalesce('0.' || p2 || '@7,0.' || p1 || '@' || q1, '') || '] canonical_asks=[' || coalesce('0.' || pa || '@' || qa, '') ||
  '] derived_complement_bids=[' || coalesce('0.' || (10 - pa) || '@' || qa, '') || '] derived_complement_asks=[' || coalesce('0.' || (10 - p2) || '@7,0.' || (10 - p1) || '@' || q1, '') || ']' AS line FROM b""")
def book_lines(spark, d):
    return books.book_lines(books.revised(book_inputs(spark, d)))


@query(f"""WITH {FEED}, s AS (SELECT market % 3 AS shard, count(*) AS frames_seen, count(DISTINCT market) AS markets, count(*) FILTER (family = 'signup') AS losses,
  max(CASE WHEN family = 'error' THEN 0 ELSE 1 END) AS connected FROM feed GROUP BY 1),
h AS (SELECT user_id % 3 AS shard, {UB.replace("us", "value")} AS ub, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT shard, ub, sum(n) OVER (PARTITION BY shard ORDER BY ub) AS cum, sum(n) OVER (PARTITION BY shard) AS total FROM h),
q AS (SELECT shard, min(ub) FILTER (cum * 1000 >= total * 990) AS p99 FROM c GROUP BY shard)
SELECT name || '{{shard="' || shard || '"}} ' || value AS line FROM (SELECT shard, unnest(['feed_shard_connected', 'feed_shard_frames_seen', 'feed_shard_continuity_losses', 'feed_shard_queue_age_p99_micros', 'feed_shard_markets']) AS name,
  unnest([connected, frames_seen, losses, p99, markets]) AS value FROM s JOIN q USING (shard))
UNION ALL SELECT 'feed_markets ' || sum(markets)::BIGINT FROM s""")
def metrics_text(spark, d):
    from ..sinks.render import metric_lines

    rows = feed(spark, d).withColumn("shard", F.col("market") % 3)
    shards = rows.groupBy("shard").agg(
        F.count(F.lit(1)).alias("frames_seen"), F.countDistinct("market").alias("markets"), F.count_if(F.col("family") == "signup").alias("continuity_losses"),
        F.max(F.when(F.col("family") == "error", 0).otherwise(1)).alias("connected"),
    )
    bounds = latency.quantiles(latency.histogram(rows, "shard", "value"), "shard", {"p99": 990}).select("shard", F.col("p99").alias("queue_age_p99_micros"))
    return metric_lines(health.gauges(shards.join(bounds, "shard")))


@query(f"""WITH {FEED} SELECT seq, '{{"t_ns":' || t_ns || ',"venue":"' || venue || '","stream":"' || stream || '","family":"' || family || '","market":"' || market || '","events":1,"bytes":' || bytes ||
  ',"handoff_ns":' || (value * 100)::BIGINT || ',"generation":' || generation || ',"text":"' || replace(props, '"', chr(92) || '"') || '"}}' AS line FROM feed""")
def tape_lines(spark, d):
    from ..sinks.render import tape_lines as lines

    rows = feed(spark, d).withColumns({"market": F.col("market").cast("string"), "handoff_ns": F.round(F.col("value") * 100).cast("long"), "text": exact.byte_cut(F.col("props"))})
    return lines(rows, "seq")
