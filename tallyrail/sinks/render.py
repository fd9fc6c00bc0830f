"""Rows as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fields of a tape line, in order.
TAPE = ["t_ns", "venue", "stream", "family", "market", "events", "bytes", "handoff_ns", "generation", "text"]


def tape_lines(rows: DataFrame, *keep: str) -> DataFrame:
    """One JSON object a row; a null market is written as null."""
    return rows.select(*keep, F.to_json(F.struct(*TAPE), {"ignoreNullFields": "false"}).alias("line"))


def metric_lines(metrics: DataFrame) -> DataFrame:
    """name{shard="n"} value of each row; a null shard has no label."""
    label = F.when(F.col("shard").isNull(), "").otherwise(F.format_string('{shard="%d"}', "shard"))
    return metrics.select(F.concat("name", label, F.lit(" "), F.col("value").cast("string")).alias("line"))


def status_line(rows: DataFrame) -> DataFrame:
    """The periodic line of a run."""
    return rows.select(F.format_string("upstream elapsed=%ds evidence=%d/%d healthy_connections=%d/%d activity=[%d, %d] faults=%d", "elapsed", "covered", "required", "healthy", "connections", "first_venue", "second_venue", "faults").alias("line"))


def control_answer(rows: DataFrame) -> DataFrame:
    """One JSON object a market: slug and status, where a reason makes status an object."""
    plain = F.to_json(F.struct(F.col("market").alias("slug"), "status"))
    tagged = F.to_json(F.struct(F.col("market").alias("slug"), F.create_map("status", "reason").alias("status")))
    return rows.select("market", F.when(F.col("reason").isNull(), plain).otherwise(tagged).alias("line"))


def table_lines(table: DataFrame, title: str) -> DataFrame:
    """A tape table (rows of venue and family, and the total where both are null) as printed: position and line, the
    total first, then by venue and family. The table has few rows, so one task numbers them."""
    row = F.format_string("  %-10s %-20s lines=%-7d events=%-8d bytes=%d", "venue", "family", "lines", "events", "bytes")
    total = F.format_string(f"{title}: lines=%d events=%d bytes=%d", "lines", "events", "bytes")
    at = F.row_number().over(W.orderBy(F.col("venue").isNotNull(), "venue", "family")) - 1
    return table.select(at.alias("position"), F.when(F.col("venue").isNull(), total).otherwise(row).alias("line"))


def exit_lines(shards: DataFrame) -> DataFrame:
    """What a stopped run prints of each shard."""
    names = ["connections", "subscriptions", "snapshots", "resolutions", "losses", "unrouted", "queue_age_max_us", "queue_age_p99_us"]
    return shards.select("shard", F.format_string("shard %d: " + " ".join(f"{n}=%d" for n in names), "shard", *names).alias("line"))


def summary_lines(counters: DataFrame) -> DataFrame:
    """The summary of a run from its one row of counters (``operators.health.run_counters``): place and line."""
    group = lambda title, names: F.format_string(f"summary {title}" + " ".join(f"{n}=%d" for n in names), *names)
    decode = F.concat(F.lit("summary decode_failures="), F.when(F.col("decode_failures") == 0, "none").otherwise(F.col("decode_failures").cast("string")))
    lines = [
        group("", ["frames_seen", "connection_attempts", "fenced_generations", "fenced_events"]),
        F.concat(F.lit("summary events "), "events"),
        group("", ["diagnostics_dropped", "overload_drops"]),
        decode,
        group("book ", ["snapshots_applied", "mutations_derived", "continuity_losses", "recovery_base_unavailable", "observer_continuity_losses"]),
    ]
    return counters.select(F.posexplode(F.array(*lines)).alias("place", "line"))
