"""Health and outcome of runs: counters, readiness, floors, fences and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .latency import histogram, quantiles

#: Seconds of unbroken health that open the measured window, and after which a serve run opens it regardless.
READY_SECONDS, TIMEOUT_SECONDS = 30, 90
#: Attempts allowed in a rolling day.
DAY_ATTEMPTS = 280
#: Least floors of a measurement.
LEAST_SECONDS, LEAST_EVENTS = 900, 10_000


def fault_total(faults: Column) -> Column:
    return F.aggregate(F.map_values(faults), F.lit(0).cast("long"), lambda a, x: a + x)


def counter_map(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The non-zero counters of each key as a map, in order of names; a key has a bounded set of names."""
    n = rows.groupBy(key, name).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias("counters"))


def activity(events: DataFrame, first: str = "orderbookUpdate", second: tuple[str, ...] = ("book", "price_change")) -> DataFrame:
    return events.agg(F.count_if(F.col("family") == first).alias("first_venue"), F.count_if(F.col("family").isin(*second)).alias("second_venue"))


def traffic(messages: DataFrame, connection: str = "connection", events: str = "events") -> DataFrame:
    """Messages received and events decoded of each connection. A message without a decoded list counts as received."""
    return messages.groupBy(connection).agg(F.count(F.lit(1)).alias("received"), F.sum(F.coalesce(F.size(events), F.lit(0)).cast("long")).alias("decoded"))


def with_evidence(connections: DataFrame, heartbeats: DataFrame, acks: DataFrame) -> DataFrame:
    """``connections`` (connection, up, subscribed, acknowledges, required) with what was seen of each: ``heartbeat``,
    and ``acked``, the distinct targets that the venue acknowledged, null where it acknowledges none."""
    beat = heartbeats.select("connection").distinct().withColumn("beat_", F.lit(True))
    seen = acks.groupBy("connection").agg(F.countDistinct("market").alias("acked_"))
    rows = connections.join(beat, "connection", "left").join(seen, "connection", "left")
    return rows.withColumns({"heartbeat": F.coalesce("beat_", F.lit(False)), "acked": F.when(F.col("acknowledges"), F.coalesce("acked_", F.lit(0)))}).drop("beat_", "acked_")


def healthy(connections: DataFrame, serve: bool) -> DataFrame:
    """healthy and all connections: up, subscribed, with a heartbeat; where targets are acknowledged, all of them, or
    some in a serve run."""
    acked = F.col("acked").isNull() | ((F.col("acked") > 0) if serve else (F.col("acked") >= F.col("required")))
    ok = F.col("up") & F.col("subscribed") & F.col("heartbeat") & acked
    return connections.agg(F.count_if(ok).alias("healthy"), F.count(F.lit(1)).alias("connections"))


def fenced(events: DataFrame, connection: str, seq: str, generation: str) -> DataFrame:
    """Adds ``stale``: the generation is behind the highest one seen before on its connection."""
    seen = F.max(generation).over(W.partitionBy(connection).orderBy(seq).rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("stale", F.col(generation) < seen)


def sequence_faults(events: DataFrame, stream: str, order: str, seq: str) -> DataFrame:
    """Per stream: gaps, repeats and steps back of a sequence number, in order of arrival."""
    before = F.lag(seq).over(W.partitionBy(stream).orderBy(order))
    rows = events.select(stream, (F.col(seq) - before).alias("step"))
    return rows.groupBy(stream).agg(F.count_if(F.col("step") > 1).alias("gaps"), F.count_if(F.col("step") == 0).alias("repeats"), F.count_if(F.col("step") < 0).alias("backs"))


def run_end(runs: DataFrame) -> DataFrame:
    """``runs`` (serve, started, opened, max_seconds) with ``ends``: a serve run's seconds count from its start, those
    of a measurement from the opening of its window, which ends never where that didn't open."""
    return runs.withColumn("ends", F.when(F.col("serve"), F.col("started")).otherwise(F.col("opened")) + F.col("max_seconds"))


def reconnects(events: DataFrame, serve: bool = True, wait: int = 5) -> DataFrame:
    """The connection attempts that follow from ``events`` (connection, seq, at, kind): generation (from 1, one more
    for each connect), and ``retry_at`` of a loss or failed attempt: ``wait`` seconds later in a serve run. A
    measurement isn't taken up again, so its retry_at is null."""
    order = W.partitionBy("connection").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    generation = F.sum((F.col("kind") == "connected").cast("long")).over(order)
    retry = F.when(F.col("kind").isin("disconnect", "connect_failed") & F.lit(serve), F.col("at") + wait)
    return events.withColumns({"generation": generation, "retry_at": retry})


def replicas(events: DataFrame) -> DataFrame:
    """The state of each market's source after every event of its replicas (market, seq, replica, kind): none is left
    after the loss of the primary, one that connects is recovering until it is live, and then it publishes."""
    order = W.partitionBy("market").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    kind = F.col("kind")
    state = F.when(kind == "live", "publishing").when(kind == "connected", "recovering").when(kind == "disconnect", "none")
    now = F.last(state, ignorenulls=True).over(order)
    return events.withColumns({"source": F.coalesce(now, F.lit("none")), "primary": F.when(now != "none", F.last(F.when(state.isNotNull(), F.col("replica")), ignorenulls=True).over(order))})


def fault_kinds(events: DataFrame, stream: str = "stream", seq: str = "seq", member: str = "member", generation: str = "generation", queued: str | None = None, capacity: int = 2048) -> DataFrame:
    """``events`` with ``fault``: overload where the queue was full, generation where it is a retired one, sequence
    where the number isn't the next of its stream, and member_order where a message's members don't rise from 0; null
    where the event is sound. The first reason that holds is given. Events of a stream come in order of ``arrival``."""
    order = W.partitionBy(stream).orderBy("arrival")
    before = lambda c: F.lag(c).over(order)
    newest = F.max(generation).over(order.rowsBetween(W.unboundedPreceding, 0))
    same = F.col(seq).eqNullSafe(before(seq))
    fault = F.when(F.col(queued) >= capacity, "overload") if queued else F.when(F.lit(False), "overload")
    fault = fault.when(F.col(generation) < newest, "generation").when(~same & before(seq).isNotNull() & (F.col(seq) != before(seq) + 1), "sequence")
    fault = fault.when(F.col(member) != F.when(same, before(member) + 1).otherwise(0), "member_order")
    return events.withColumn("fault", fault)


#: What a run's summary counts, by the kind of the record that it counts.
RUN_COUNTERS = {
    "frames_seen": "frame", "connection_attempts": "connect", "fenced_generations": "fenced_generation", "fenced_events": "fenced_event", "diagnostics_dropped": "diagnostic_dropped",
    "overload_drops": "overload", "decode_failures": "malformed", "snapshots_applied": "snapshot", "mutations_derived": "mutation", "continuity_losses": "loss",
    "recovery_base_unavailable": "no_recovery_base", "observer_continuity_losses": "observer_loss",
}
#: What a shard's exit line counts.
SHARD_COUNTERS = {"connections": "connect", "subscriptions": "subscribe", "snapshots": "snapshot", "resolutions": "resolved", "losses": "loss", "unrouted": "unrouted"}


def run_counters(records: DataFrame) -> DataFrame:
    """One row with every counter of a run's summary, from records of (kind, family), and ``events``: the families'
    counts as text, in order of names. A counter without records is 0."""
    kinds = records.agg(*[F.count_if(F.col("kind") == kind).alias(name) for name, kind in RUN_COUNTERS.items()])
    families = records.filter("family IS NOT NULL").groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    text = families.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("family", "n"))), lambda x: F.concat(x["family"], F.lit("="), x["n"].cast("string"))), " ").alias("events"))
    return kinds.crossJoin(F.broadcast(text))  # one row each


def shard_counters(records: DataFrame) -> DataFrame:
    """A row for each shard with the counters of its exit line, the exact maximum of queue_age_us and its p99 bound."""
    counts = records.groupBy("shard").agg(*[F.count_if(F.col("kind") == kind).alias(name) for name, kind in SHARD_COUNTERS.items()], F.max("queue_age_us").cast("long").alias("queue_age_max_us"))
    bounds = quantiles(histogram(records.filter("queue_age_us IS NOT NULL"), "shard", "queue_age_us"), "shard", {"p99": 990})
    return counts.join(bounds.select("shard", F.col("p99").alias("queue_age_p99_us")), "shard", "left").fillna(0, ["queue_age_max_us", "queue_age_p99_us"])


def gauges(shards: DataFrame) -> DataFrame:
    """name, shard and value of each metric: five of every shard, from its columns connected, frames_seen,
    continuity_losses, queue_age_p99_micros and markets, and the markets of all without a shard."""
    names = ["connected", "frames_seen", "continuity_losses", "queue_age_p99_micros", "markets"]
    each = shards.select("shard", F.explode(F.create_map(*[x for n in names for x in (F.lit(f"feed_shard_{n}"), F.col(n).cast("long"))])).alias("name", "value"))
    total = shards.agg(F.sum("markets").cast("long").alias("value")).select(F.lit("feed_markets").alias("name"), F.lit(None).cast("long").alias("shard"), "value")
    return each.select("name", F.col("shard").cast("long").alias("shard"), "value").unionByName(total)


def readiness(health: DataFrame, run: str, seconds: str, ok: str, ready: int = READY_SECONDS, timeout: int | None = None) -> DataFrame:
    """When the measured window of each run opens: the first moment at which its connections were healthy for
    ``ready`` seconds in a row, or ``timeout`` after the start if that comes first or never."""
    order = W.partitionBy(run).orderBy(seconds)
    island = F.sum((~F.col(ok)).cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = health.withColumn("island", island).filter(ok)
    spans = rows.groupBy(run, "island").agg(F.min(seconds).alias("since"), F.max(seconds).alias("until"))
    by_ready = spans.filter(F.col("until") - F.col("since") >= ready).groupBy(run).agg((F.min("since") + ready).alias("ready_at"))
    starts = health.groupBy(run).agg(F.min(seconds).alias("start"))
    out = starts.join(by_ready, run, "left")
    if timeout is None:
        return out.select(run, F.col("ready_at").alias("opened"), F.when(F.col("ready_at").isNotNull(), "readiness").alias("by"))
    late = F.col("start") + timeout
    return out.select(run, F.least("ready_at", late).alias("opened"), F.when(F.col("ready_at") <= late, "readiness").otherwise("timeout").alias("by"))


def qualified(events: DataFrame, run_seconds: Column, venues: list[str], least_seconds: int = LEAST_SECONDS, least_events: int = LEAST_EVENTS) -> DataFrame:
    """Whether a measurement met its floors: every venue of ``venues`` needs ``least_events``, a venue without events
    fails like one with few."""
    tally = events.agg(*[F.count_if(F.col("venue") == v).alias(f"n{k}") for k, v in enumerate(venues)], run_seconds.alias("seconds"))
    enough = F.lit(True)
    for k in range(len(venues)):
        enough = enough & (F.col(f"n{k}") >= least_events)
    ok = (F.col("seconds") >= least_seconds) & enough
    return tally.select("seconds", F.least(*[F.col(f"n{k}") for k in range(len(venues))]).alias("least_events"), ok.alias("qualified"))


def outcome(runs: DataFrame) -> DataFrame:
    """reason and exit code of each run from its facts: serve, signal, resolved, faults, timed_out, floors_met."""
    reason = (
        F.when(F.col("signal") == "INT", "operator_interrupt").when(F.col("signal") == "TERM", "operator_terminate")
        .when(F.col("resolved"), "selected_target_resolved").when(~F.col("serve") & (F.col("faults") > 0), "fault")
        .when(~F.col("serve") & F.col("floors_met"), "healthy_floors_reached").when(F.col("serve") & F.col("timed_out"), "serve_max_seconds")
        .otherwise("insufficient_samples")
    )
    code = F.when(F.col("serve") & F.col("signal").isNotNull(), 0).when(~F.col("serve") & F.col("signal").isNull() & (F.col("faults") == 0) & F.col("floors_met"), 0).otherwise(2)
    return runs.withColumns({"reason": reason, "exit_code": code})


def attempts(rows: DataFrame, at: str, seconds: int = 86_400, most: int = DAY_ATTEMPTS) -> DataFrame:
    """``rows`` with ``attempts``, those of the ``seconds`` up to each row and the row's own second, over all processes,
    and ``exhausted``: whether they are over ``most``.

    Rows are counted by second first. A day then has at most ``seconds`` counts; it meets the counts of the day before
    at the same places of the day, and what lies in the rolling day is the running sum of its own counts and what the
    day before has from this place on. So a task sorts two days of counts and every frame only grows.
    """
    counts = rows.groupBy(F.col(at).alias("at_")).agg(F.count(F.lit(1)).alias("n"))
    day, place = F.floor(F.col("at_") / seconds), F.pmod("at_", F.lit(seconds))
    own = counts.select(day.alias("day"), place.alias("place"), F.col("n").alias("now"), F.lit(0).cast("long").alias("old"), "at_")
    last = counts.select((day + 1).alias("day"), place.alias("place"), F.lit(0).cast("long").alias("now"), F.col("n").alias("old"), F.lit(None).cast("long").alias("at_"))
    of_day = W.partitionBy("day").orderBy("place")
    now = F.sum("now").over(of_day.rangeBetween(W.unboundedPreceding, 0))
    gone = F.coalesce(F.sum("old").over(of_day.rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = own.unionByName(last).withColumn("attempts", now + F.sum("old").over(W.partitionBy("day")) - gone).filter("at_ IS NOT NULL").select("at_", "attempts")
    return rows.join(found, F.col(at) == F.col("at_")).drop("at_").withColumn("exhausted", F.col("attempts") > most)
