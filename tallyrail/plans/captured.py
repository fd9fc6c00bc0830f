"""Readers, sinks and printed lines applied to the test tables: what is written is read back, and SQL gives the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from ..operators import books, health, latency, routing, selection, tape
from ..sinks import files as sinks
from ..sinks import render
from ..sources import files
from .queries import BOOKS, COUNTS, FEED, LEVELS, UB, book_inputs, feed, query, table


def place(spark: SparkSession) -> str:
    """A new path in the folder that all nodes share."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or f"{spark.conf.get('spark.sql.warehouse.dir')}/captured"
    return f"{shared.rstrip('/')}/captured-{uuid.uuid4().hex}"


TICK, ROOM = 600, 6


@query(f"""WITH {FEED}, s AS (SELECT stream, t_ns, seq, (t_ns - min(t_ns) OVER (PARTITION BY stream)) // {TICK}000000000 AS slot FROM feed),
l AS (SELECT stream, list_prepend({{'q': 0::BIGINT, 'd': 0::BIGINT, 'slot': 0::BIGINT}}, list({{'q': 0::BIGINT, 'd': 0::BIGINT, 'slot': slot}} ORDER BY t_ns, seq)) AS steps FROM s GROUP BY stream),
r AS (SELECT stream, len(steps) - 1 AS lines, list_reduce(steps, lambda a, x: {{'q': least({ROOM}, greatest(0, a.q - (x.slot - a.slot)) + 1),
  'd': a.d + CASE WHEN greatest(0, a.q - (x.slot - a.slot)) >= {ROOM} THEN 1 ELSE 0 END, 'slot': x.slot}}) AS z FROM l)
SELECT stream, lines, z.d AS dropped, z.q AS queued FROM r""")
def bounded_tape(spark, d):
    """Lines, dropped lines and what is queued at the end of each stream, for a queue of six lines and a slow reader."""
    rows = tape.bounded_tape(feed(spark, d).select("stream", "t_ns", "seq"), ROOM, 1, TICK * 1_000_000_000, 1000)
    last = F.max_by("queued", F.struct("t_ns", "seq")).alias("queued")
    return rows.groupBy("stream").agg(F.count(F.lit(1)).alias("lines"), F.count_if("dropped").alias("dropped"), last)


def written_messages(spark, d) -> DataFrame:
    """Five events a message, one JSON object a line; a message that begins with an error is cut off."""
    e = table(spark, d, "events").withColumn("batch", F.floor(F.col("event_id") / 5))
    level = F.struct((F.col("event_id") % 9 + 1).cast("string").alias("price"), F.lit("7").alias("qty"))
    event = F.struct("event_id", F.col("event_type").alias("family"), F.col("user_id").cast("string").alias("market"), F.array(level).alias("bids"))
    m = e.groupBy("batch").agg(F.array_sort(F.collect_list(event)).alias("events"))
    body = F.to_json(F.struct(F.concat(F.lit("c"), F.get("events", 0)["market"]).alias("connection"), F.lit(1).alias("generation"), F.col("batch").alias("seq"), F.lit("snapshot").alias("kind"), "events"))
    m.select(F.when(F.get("events", 0)["family"] == "error", F.left(body, F.lit(40))).otherwise(body).alias("frame")).write.text(path := place(spark))
    return files.read_messages(spark, path)


MESSAGES = """message AS (SELECT event_id // 5 AS seq, arg_min(event_type, event_id) AS head, arg_min(user_id, event_id) AS c, count(*) AS n FROM events GROUP BY 1)"""


@query(f"""WITH {MESSAGES} SELECT seq, event_id - min(event_id) OVER (PARTITION BY seq) AS place, event_type AS family, user_id::VARCHAR AS market, (event_id % 9 + 1)::VARCHAR AS price
FROM events JOIN message ON seq = event_id // 5 WHERE head <> 'error'""")
def decoded_events(spark, d):
    events, _ = files.decoded_messages(written_messages(spark, d))
    return events.select("seq", F.col("place").cast("long").alias("place"), "family", "market", F.get("bids", 0)["price"].alias("price"))


@query(f"""WITH {MESSAGES} SELECT count(*) FILTER (head <> 'error') AS valid, count(*) FILTER (head = 'error') AS malformed, coalesce(sum(n) FILTER (head <> 'error'), 0)::BIGINT AS events FROM message""")
def malformed_payloads(spark, d):
    m = written_messages(spark, d)
    return m.agg(F.count_if(F.col("malformed").isNull()).alias("valid"), F.count("malformed").alias("malformed"), F.coalesce(F.sum(F.size("events")), F.lit(0)).cast("long").alias("events"))


@query(f"""WITH {MESSAGES} SELECT 'c' || c AS connection, count(*) AS received, sum(n)::BIGINT AS decoded FROM message WHERE head <> 'error' GROUP BY c""")
def connection_traffic(spark, d):
    return health.traffic(written_messages(spark, d).filter("connection IS NOT NULL"))


@query("SELECT props AS frame, count(*) AS n FROM events GROUP BY props")
def recorded_frames(spark, d):
    sinks.record(table(spark, d, "events").select(F.col("props").alias("frame")), path := place(spark))
    return spark.read.text(path).groupBy(F.col("value").alias("frame")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FEED} SELECT venue, family, {COUNTS}, sum(handoff) AS handoff_ns FROM (SELECT *, (value * 100)::BIGINT AS handoff FROM feed) GROUP BY ALL")
def tape_read_back(spark, d):
    rows = feed(spark, d).withColumns({"market": F.col("market").cast("string"), "handoff_ns": F.round(F.col("value") * 100).cast("long"), "text": exact.byte_cut(F.col("props"))})
    render.tape_lines(rows).write.text(path := place(spark))
    read = files.read_tape(spark, path)
    return tape.tape_table(read, "venue", "family").join(read.groupBy("venue", "family").agg(F.sum("handoff_ns").cast("decimal(38,0)").alias("handoff_ns")), ["venue", "family"])


@query(f"""WITH {FEED}, t AS (SELECT venue, family, {COUNTS} FROM feed GROUP BY GROUPING SETS ((venue, family), ()))
SELECT (row_number() OVER (ORDER BY venue IS NOT NULL, venue, family) - 1)::INT AS position, CASE WHEN venue IS NULL THEN 'tape since start: lines=' || lines || ' events=' || events || ' bytes=' || bytes
  ELSE '  ' || rpad(venue, 10, ' ') || ' ' || rpad(family, 20, ' ') || ' lines=' || rpad(lines::VARCHAR, 7, ' ') || ' events=' || rpad(events::VARCHAR, 8, ' ') || ' bytes=' || bytes END AS line FROM t""")
def printed_table(spark, d):
    return render.table_lines(tape.tape_with_total(feed(spark, d)), "tape since start")


@query("""SELECT 'limitless' AS venue, s_name AS market, NULL AS token, s_suppkey + 2000000000 AS end_epoch FROM supplier
UNION ALL SELECT 'polymarket', n_name, n_nationkey || t, n_nationkey + 2000000000 FROM nation, (VALUES ('a'), ('b')) v(t)""")
def selection_file(spark, d):
    """A selection file is written, read, checked and laid out as subscription targets."""
    s = table(spark, d, "supplier").select(F.struct(F.col("s_name").alias("slug"), (F.col("s_suppkey") + 2_000_000_000).alias("end_epoch"), F.lit("x").alias("title")).alias("r"))
    tokens = F.array(*[F.concat(F.col("n_nationkey").cast("string"), F.lit(t)) for t in "ab"])
    n = table(spark, d, "nation").select(F.struct(F.col("n_name").alias("condition_id"), tokens.alias("clob_token_ids"), (F.col("n_nationkey").cast("long") + 2_000_000_000).alias("end_epoch")).alias("r"))
    both = s.agg(F.collect_list("r").alias("limitless")).crossJoin(F.broadcast(n.agg(F.collect_list("r").alias("polymarket"))))  # one file is one row
    both.select(F.to_json(F.struct("limitless", "polymarket")).alias("value")).coalesce(1).write.text(path := place(spark))
    rows = selection.validated(files.read_selection(spark, path), 2_000_000_000 - 1)
    ends = rows.select("venue", "market", "end_epoch")
    return selection.targets(rows).join(ends, ["venue", "market"]).select("venue", "market", F.col("asset").alias("token"), "end_epoch")


@query("""SELECT o_custkey::VARCHAR AS event, o_orderpriority AS tag, 1700000000 AS start, o_orderkey::VARCHAR AS market, o_orderkey || 'y' AS token, epoch(date_trunc('day', o_orderdate))::BIGINT AS end_epoch FROM orders""")
def discovered_markets(spark, d):
    """Orders as captured discovery answers: an event for each customer and priority."""
    o = table(spark, d, "orders")
    end = F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")
    market = F.struct(F.col("o_orderkey").cast("string").alias("conditionId"), F.array(F.concat("o_orderkey", F.lit("y")), F.concat("o_orderkey", F.lit("n"))).alias("clobTokenIds"), end.alias("endDate"))
    answers = o.groupBy(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderpriority").alias("tag")).agg(F.collect_list(market).alias("markets"))
    answers.select(F.to_json(F.struct("id", "tag", F.lit("2023-11-14T22:13:20Z").alias("startDate"), "markets")).alias("value")).write.text(path := place(spark))
    found = files.read_markets(spark, path)
    return found.select("event", "tag", "start", "market", F.get("tokens", 0).alias("token"), "end_epoch")


@query(f"""WITH s AS (SELECT user_id % 3 AS shard, event_type AS family, value * 8 AS us FROM events), h AS (SELECT shard, family, {UB} AS ub, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT shard, family, ub, sum(n) OVER (PARTITION BY shard, family ORDER BY ub) AS cum, sum(n) OVER (PARTITION BY shard, family) AS total FROM h),
q AS (SELECT shard, family, max(total)::BIGINT AS events, min(ub) FILTER (cum * 1000 >= total * 500) AS p50_ub_us, min(ub) FILTER (cum * 1000 >= total * 990) AS p99_ub_us FROM c GROUP BY ALL)
SELECT 's-' || shard AS stream, sum(events) OVER (PARTITION BY shard)::BIGINT AS received, family, events, p50_ub_us, p99_ub_us, max_ns, errors FROM q
JOIN (SELECT shard, family, round(max(us) * 1000)::BIGINT AS max_ns FROM s GROUP BY ALL) USING (shard, family)
JOIN (SELECT shard, count(*) FILTER (family = 'error') AS errors FROM s GROUP BY shard) USING (shard)""")
def report_file(spark, d):
    """A report is written once from its operators' results, and read again."""
    s = table(spark, d, "events").select((F.col("user_id") % 3).alias("shard"), F.concat(F.lit("s-"), (F.col("user_id") % 3).cast("string")).alias("stream"), F.col("event_type").alias("family"), (F.col("value") * 8).alias("us"))
    key = F.concat_ws("/", "stream", "family")
    bounds = latency.quantiles(latency.histogram(s.withColumn("key", key), "key", "us"), "key", {"p50_ub_us": 500, "p99_ub_us": 990})
    most = s.groupBy("stream", "family").agg(F.round(F.max("us") * 1000).cast("long").alias("max_ns")).withColumn("key", key)
    families = most.join(bounds, "key").withColumnRenamed("samples", "events")
    counts = health.counter_map(s.filter("family = 'error'"), "stream", "family").withColumnRenamed("counters", "faults")
    shards = s.groupBy("shard", "stream").agg(F.count(F.lit(1)).alias("received")).join(counts, "stream", "left")
    head = {"schema": "upstream", "reason": "serve_max_seconds", "qualified": False, "window_seconds": 245}
    sinks.write_report(sinks.report_row(head, shards, families), path := place(spark))
    read = files.read_report(spark, path).select("stream", "received", F.coalesce(F.col("faults")["error"], F.lit(0)).cast("long").alias("errors"), F.explode("families").alias("f"))
    return read.select("stream", "received", "f.*", "errors")


@query(f"""WITH {BOOKS} SELECT market, revision, authority, continuity_epoch, seq FROM books""")
def published_books(spark, d):
    states = books.revised(book_inputs(spark, d)).withColumn("shard", F.col("market") % 4)
    sinks.publish(states, path := place(spark))
    return spark.read.parquet(path).select("market", "revision", "authority", "continuity_epoch", "seq")


@query(f"""WITH {BOOKS} SELECT revision, 'bbo revision=' || revision || ' authority=' || authority || ' best_bid=' || coalesce('0.' || (i % 2 + 5) || '@7', '-') ||
  ' best_ask=' || coalesce('0.' || (i % 2 + 8) || '@' || (i % 5 + 1), '-') AS line FROM books WHERE market = 7""")
def attached_book(spark, d):
    """A consumer attaches to one market of a published segment and prints its states."""
    sinks.publish(books.revised(book_inputs(spark, d)).withColumn("shard", F.col("market") % 4), path := place(spark))
    return books.bbo_lines(files.attach(spark, path, 7)).select("revision", "line")


@query(f"""WITH {LEVELS} SELECT market, 'mutation revision=' || revision || ' cursor=' || continuity_epoch || ':' || row_number() OVER (PARTITION BY market, continuity_epoch ORDER BY seq, side, p) || ' origin=snapshot side=' || side ||
  ' price=0.' || p || ' qty=' || coalesce(old_q::VARCHAR, 'none') || '->' || coalesce(new_q::VARCHAR, 'none') AS line FROM diff""")
def mutation_text(spark, d):
    return books.mutation_lines(books.mutations(books.revised(book_inputs(spark, d))))


@query(f"""WITH {LEVELS} SELECT market, 'summary book snapshots_applied=' || count(*) FILTER (NOT loss) || ' mutations_derived=' || coalesce(any_value(n), 0) || ' continuity_losses=' || count(*) FILTER (loss) AS line
FROM books LEFT JOIN (SELECT market, count(*) AS n FROM diff GROUP BY 1) USING (market) GROUP BY market""")
def book_summary_text(spark, d):
    return books.summary_lines(books.summary(book_inputs(spark, d)))


RESOLVED = LEVELS.replace("FROM events", "FROM (SELECT * FROM events WHERE event_type <> 'purchase')")


@query(f"""WITH {RESOLVED}, m AS (SELECT market, seq, continuity_epoch, count(*) AS n FROM diff GROUP BY ALL),
p AS (SELECT user_id AS market, event_id AS seq, event_type, count(*) FILTER (event_type <> 'purchase') OVER w AS revision, count(*) FILTER (event_type = 'signup') OVER w AS epoch FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT p.market, p.seq, p.revision, p.epoch, coalesce(sum(n), 0)::BIGINT AS position FROM p LEFT JOIN m ON m.market = p.market AND m.continuity_epoch = p.epoch AND m.seq <= p.seq WHERE event_type = 'purchase' GROUP BY ALL)
SELECT market, r.seq AS seq, 'resolution revision=' || revision || ' cursor=' || epoch || ':' || position || ' origin=venue outcome=' || (CASE WHEN value > 50 THEN 'YES' ELSE 'NO' END) ||
  ' index=' || event_id % 2 || ' type=final date=' || strftime(ts, '%Y-%m-%d') || ' path=' || event_id AS line FROM r JOIN events ON event_id = r.seq""")
def resolution_text(spark, d):
    """Purchases resolve a market and change neither book nor revision."""
    e = table(spark, d, "events")
    kinds = e.select(F.col("event_id").alias("seq"), "event_type")
    inputs = book_inputs(spark, d).join(kinds, "seq").withColumn("kind", F.when(F.col("event_type") == "purchase", "resolved").otherwise(F.col("kind")))
    states = books.revised(inputs, resolutions=True)
    outcome = F.when(F.col("value") > 50, "YES").otherwise("NO")
    outcomes = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("market"), F.col("event_id").alias("seq"), outcome.alias("outcome"), (F.col("event_id") % 2).alias("index"), F.lit("final").alias("type"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").cast("string").alias("path"))
    return books.resolution_lines(states, books.mutations(states), outcomes)


@query(f"""WITH {FEED} SELECT 'upstream elapsed=' || ((max(t_ns) - min(t_ns)) // 1000000000) || 's evidence=' || (SELECT count(DISTINCT user_id) FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'signup') || '/' ||
  (SELECT count(*) FROM customer) || ' healthy_connections=' || (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'signup') > 0 AND count(*) FILTER (event_type = 'view') > 0 AND max(value) > 100)) || '/' ||
  count(DISTINCT market) || ' activity=[' || count(*) FILTER (family = 'view') || ', ' || count(*) FILTER (family IN ('click', 'purchase')) || '] faults=' || count(*) FILTER (family = 'error') AS line FROM feed""")
def status_text(spark, d):
    """The periodic line, from the operators that count its parts; each part is one row."""
    rows, e = feed(spark, d), table(spark, d, "events").withColumnRenamed("user_id", "connection")
    kind = lambda x: F.count_if(F.col("event_type") == x) > 0
    c = e.groupBy("connection").agg(kind("signup").alias("up"), kind("view").alias("subscribed"), F.lit(False).alias("acknowledges"), F.lit(0).alias("required"))
    healthy = health.healthy(health.with_evidence(c, e.filter("value > 100"), e.limit(0).select("connection", F.lit(0).alias("market"))), serve=True)
    targets = table(spark, d, "customer").select(F.col("c_custkey").alias("market"), F.lit(1).alias("all"))
    covered = routing.coverage(targets, e.filter("event_type = 'signup'").select(F.col("connection").alias("market")), ["market"], "all").drop("all")
    clock = rows.agg(F.expr("(max(t_ns) - min(t_ns)) div 1000000000").alias("elapsed"))
    faults = health.counter_map(e.filter("event_type = 'error'").withColumn("all", F.lit(1)), "all", "event_type").select(health.fault_total(F.col("counters")).alias("faults"))
    line = clock
    for part in (covered, healthy, health.activity(rows, "view", ("click", "purchase")), faults):
        line = line.crossJoin(F.broadcast(part))
    return render.status_line(line)


@query("""WITH d AS (SELECT DISTINCT user_id AS market FROM events WHERE event_type = 'view'), a AS (SELECT c_custkey AS market FROM customer)
SELECT market, CASE WHEN market IN (SELECT market FROM d) THEN '{"slug":"' || market || '","status":"removed"}' ELSE '{"slug":"' || market || '","status":{"rejected":"not desired"}}' END AS line FROM a""")
def control_answers(spark, d):
    desired = table(spark, d, "events").filter("event_type = 'view'").select(F.col("user_id").cast("string").alias("market"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("market"))
    answers = render.control_answer(selection.answers(desired, asked, asked, add=False))
    return answers.select(F.col("market").cast("long").alias("market"), "line")


RECORDS = {"view": "frame", "click": "snapshot", "signup": "connect", "purchase": "resolved", "error": "loss"}


def records(spark, d) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in RECORDS.items() for x in pair])
    e = table(spark, d, "events")
    return e.select(kinds[F.col("event_type")].alias("kind"), F.col("event_type").alias("family"), (F.col("user_id") % 3).alias("shard"), F.when(F.col("event_type") == "view", F.col("value")).alias("queue_age_us"))


@query("""SELECT unnest(['summary frames_seen=' || count(*) FILTER (event_type = 'view') || ' connection_attempts=' || count(*) FILTER (event_type = 'signup') || ' fenced_generations=0 fenced_events=0',
  'summary events ' || (SELECT string_agg(event_type || '=' || n, ' ' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)),
  'summary diagnostics_dropped=0 overload_drops=0', 'summary decode_failures=none',
  'summary book snapshots_applied=' || count(*) FILTER (event_type = 'click') || ' mutations_derived=0 continuity_losses=' || count(*) FILTER (event_type = 'error') || ' recovery_base_unavailable=0 observer_continuity_losses=0']) AS line FROM events""")
def run_summary(spark, d):
    return render.summary_lines(health.run_counters(records(spark, d))).select("line")


@query(f"""WITH e AS (SELECT user_id % 3 AS shard, event_type AS t, value AS us FROM events), h AS (SELECT shard, {UB} AS ub, count(*) AS n FROM e WHERE t = 'view' GROUP BY ALL),
c AS (SELECT shard, ub, sum(n) OVER (PARTITION BY shard ORDER BY ub) AS cum, sum(n) OVER (PARTITION BY shard) AS total FROM h),
q AS (SELECT shard, min(ub) FILTER (cum * 1000 >= total * 990) AS p99 FROM c GROUP BY shard)
SELECT shard, 'shard ' || shard || ': connections=' || count(*) FILTER (t = 'signup') || ' subscriptions=0 snapshots=' || count(*) FILTER (t = 'click') || ' resolutions=' || count(*) FILTER (t = 'purchase') || ' losses=' || count(*) FILTER (t = 'error') ||
  ' unrouted=0 queue_age_max_us=' || trunc(max(us) FILTER (t = 'view'))::BIGINT || ' queue_age_p99_us=' || any_value(p99) AS line FROM e JOIN q USING (shard) GROUP BY shard""")
def shard_exits(spark, d):
    return render.exit_lines(health.shard_counters(records(spark, d)))


@query("""SELECT user_id AS run, CASE WHEN max(value) > 300 THEN min(epoch(ts)::BIGINT) WHEN count(*) > 40 THEN max(epoch(ts)::BIGINT) END + 3600 AS ends FROM (SELECT user_id, value, date_trunc('second', ts) AS ts FROM events) GROUP BY 1""")
def run_ends(spark, d):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    runs = table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg((F.max("value") > 300).alias("serve"), F.min(at).alias("started"), F.when(F.count(F.lit(1)) > 40, F.max(at)).alias("opened"), F.lit(3600).alias("max_seconds"))
    return health.run_end(runs).select("run", "ends")


@query("""SELECT event_id AS seq, count(*) FILTER (event_type = 'signup') OVER w AS generation, CASE WHEN event_type IN ('error', 'purchase') THEN epoch(date_trunc('second', ts))::BIGINT + 5 END AS retry_at FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def reconnect_plan(spark, d):
    kind = F.when(F.col("event_type") == "signup", "connected").when(F.col("event_type") == "error", "disconnect").when(F.col("event_type") == "purchase", "connect_failed").otherwise("data")
    rows = table(spark, d, "events").select(F.col("user_id").alias("connection"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), kind.alias("kind"))
    return health.reconnects(rows).select("seq", F.col("generation").cast("long").alias("generation"), "retry_at")


@query("""WITH s AS (SELECT event_id AS seq, user_id, event_id % 2 AS replica, CASE event_type WHEN 'signup' THEN 'recovering' WHEN 'click' THEN 'publishing' WHEN 'error' THEN 'none' END AS state FROM events),
t AS (SELECT seq, last_value(state IGNORE NULLS) OVER w AS state, last_value(CASE WHEN state IS NOT NULL THEN replica END IGNORE NULLS) OVER w AS replica FROM s WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT seq, coalesce(state, 'none') AS source, CASE WHEN state <> 'none' THEN 'feed#' || replica END AS primary FROM t""".replace("AS primary", 'AS "primary"'))
def replica_states(spark, d):
    kind = F.when(F.col("event_type") == "signup", "connected").when(F.col("event_type") == "click", "live").when(F.col("event_type") == "error", "disconnect").otherwise("data")
    rows = table(spark, d, "events").select(F.col("user_id").alias("market"), F.col("event_id").alias("seq"), F.concat(F.lit("feed#"), (F.col("event_id") % 2).cast("string")).alias("replica"), kind.alias("kind"))
    return health.replicas(rows).select("seq", "source", "primary")


@query("""WITH e AS (SELECT user_id, event_id, event_id // 4 AS s, event_id % 4 AS m, floor(value / 100)::BIGINT AS g FROM events),
w AS (SELECT *, lag(s) OVER o AS ls, lag(m) OVER o AS lm, max(g) OVER (o ROWS UNBOUNDED PRECEDING) AS top FROM e WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT user_id AS stream, CASE WHEN g < top THEN 'generation' WHEN ls IS NOT NULL AND s <> ls AND s <> ls + 1 THEN 'sequence' WHEN m <> (CASE WHEN s = ls THEN lm + 1 ELSE 0 END) THEN 'member_order' END AS fault FROM w)
SELECT stream, coalesce(fault, 'none') AS fault, count(*) AS n FROM f GROUP BY ALL""")
def admission_faults(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("stream"), i.alias("arrival"), F.floor(i / 4).alias("seq"), (i % 4).alias("member"), F.floor(F.col("value") / 100).alias("generation"))
    return health.fault_kinds(rows).groupBy("stream", F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BOOKS}, want AS (SELECT DISTINCT user_id AS market FROM events WHERE event_type = 'view'), have AS (SELECT DISTINCT user_id AS market FROM events WHERE value > 200),
s AS (SELECT coalesce(want.market, have.market) AS market, CASE WHEN have.market IS NULL THEN 'subscribing' WHEN want.market IS NULL THEN 'removing' ELSE 'established' END AS subscription FROM want FULL OUTER JOIN have ON want.market = have.market),
b AS (SELECT market, arg_max(authority, revision) AS authority FROM books GROUP BY market)
SELECT market, subscription, CASE WHEN subscription = 'removing' THEN 'removed' WHEN authority LIKE 'Stale%' THEN 'stale(disconnect)' WHEN subscription = 'established' AND authority = 'Live' THEN 'live' ELSE 'reconciling' END AS status FROM s LEFT JOIN b USING (market)""")
def market_lifecycle(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "market")
    sets = routing.reconciled(e.filter("event_type = 'view'"), e.filter("value > 200"))
    latest = books.revised(book_inputs(spark, d)).groupBy("market").agg(F.max_by("authority", "revision").alias("authority"))
    return sets.join(latest, "market", "left").select("market", "subscription", routing.lifecycle(F.col("subscription"), F.col("authority")).alias("status"))
