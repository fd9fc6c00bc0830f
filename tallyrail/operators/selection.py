"""Selections: which markets a run subscribes to, their targets and shards, and how files are pruned and built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows on one connection, and seconds of a pruned row's least remaining life.
PER_SHARD, PRUNE_SECONDS = 100, 3600
#: Seconds by which a measurement's rows must outlive its longest run.
MEASUREMENT_MARGIN = 210


class SelectionError(ValueError):
    """A selection that no run accepts; exit code 2."""

    code = 2


def rows_of(selection: DataFrame) -> DataFrame:
    """venue, position in the file, market, tokens and end_epoch of every row of a selection file."""
    limitless = selection.select(F.posexplode("limitless").alias("position", "r")).select(
        F.lit("limitless").alias("venue"), "position", F.col("r.slug").alias("market"), F.lit(None).cast("array<string>").alias("tokens"), F.col("r.end_epoch").alias("end_epoch")
    )
    polymarket = selection.select(F.posexplode("polymarket").alias("position", "r")).select(
        F.lit("polymarket").alias("venue"), "position", F.col("r.condition_id").alias("market"), F.col("r.clob_token_ids").alias("tokens"), F.col("r.end_epoch").alias("end_epoch")
    )
    return limitless.unionByName(polymarket)


def validated(selection: DataFrame, now: int, serve: bool = True, max_seconds: int = 0) -> DataFrame:
    """The rows of a selection, or an error: both lists must be there and one must have rows; every row needs an end
    later than now (serve) or ``max_seconds`` and a margin later (measurement)."""
    head = selection.select(F.size("limitless").alias("a"), F.size("polymarket").alias("b"), F.col("limitless").isNull().alias("x"), F.col("polymarket").isNull().alias("y")).first()
    if head is None or head.x or head.y:
        raise SelectionError("both lists must be present")
    if head.a + head.b == 0:
        raise SelectionError("the selection is empty")
    rows = rows_of(selection)
    if not expired(rows, now, serve, max_seconds).isEmpty():
        raise SelectionError("a row has ended, or ends too soon, or has no end")
    return rows


def expired(rows: DataFrame, now: int, serve: bool = True, max_seconds: int = 0) -> DataFrame:
    """Rows that forbid a run."""
    if serve:
        return rows.filter(F.col("end_epoch").isNull() | (F.col("end_epoch") <= now))
    return rows.filter(F.col("end_epoch").isNull() | (F.col("end_epoch") < now + max_seconds + MEASUREMENT_MARGIN))


def targets(rows: DataFrame) -> DataFrame:
    """One row per subscription coordinate: a slug is one target, a condition one for each token."""
    return rows.select("venue", "market", F.explode_outer("tokens").alias("asset"))


def sharded(rows: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """shard and stream name of each row: ``per_shard`` rows to a connection, per venue, in file order."""
    order = F.row_number().over(W.partitionBy("venue").orderBy("position"))
    shard = F.floor((order - 1) / per_shard).cast("long")
    return rows.withColumn("shard", shard).withColumn("stream", F.concat_ws("-", "venue", F.col("shard").cast("string")))


def pruned(rows: DataFrame, now: int) -> DataFrame:
    return rows.filter(F.col("end_epoch") > now + PRUNE_SECONDS)


def lasting(rows: DataFrame, now: int, days: int = 5) -> DataFrame:
    return rows.filter(F.col("end_epoch") >= now + days * 86_400)


def per_event(rows: DataFrame, event: str, most: int = 4) -> DataFrame:
    """At most ``most`` markets of an event: those that end first, ties by market."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(event).orderBy("end_epoch", "market"))).filter(F.col("rank") <= most).drop("rank")


def upcoming(rows: DataFrame, now: int, start: str, cap: int = 200) -> DataFrame:
    """Games still to come first, by start, then the others; the first ``cap`` rows."""
    return rows.orderBy((F.col(start) < now).cast("int"), start, "market").limit(cap)


def merged(rows: DataFrame, limitless: DataFrame) -> DataFrame:
    """A selection with the Limitless rows of another file in place of its own."""
    return rows.filter("venue <> 'limitless'").unionByName(limitless.filter("venue = 'limitless'"))


def valid_until(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("end_epoch").alias("valid_until"))


def added(desired: DataFrame, asked: DataFrame) -> DataFrame:
    """The desired set after ``add``."""
    return desired.select("market").union(asked.select("market")).distinct()


def removed(desired: DataFrame, asked: DataFrame) -> DataFrame:
    """The desired set after ``remove``."""
    return desired.select("market").distinct().join(asked.select("market"), "market", "left_anti")


def answers(desired: DataFrame, asked: DataFrame, known: DataFrame, add: bool) -> DataFrame:
    """market, status and reason for each asked market: added markets must be known, removed ones be desired."""
    pool = known if add else desired
    found = asked.select("market").distinct().join(pool.select("market", F.lit(True).alias("hit")).distinct(), "market", "left")
    done = "accepted" if add else "removed"
    reason = "unknown market" if add else "not desired"
    return found.select("market", F.when(F.col("hit"), done).otherwise("rejected").alias("status"), F.when(F.col("hit").isNull(), reason).alias("reason"))
