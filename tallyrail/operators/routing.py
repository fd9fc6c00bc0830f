"""Lookups between events, targets, connections and markets. Sides are broadcast only where Spark measures them small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def routed(events: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    return events.join(targets, keys)


def unrouted(events: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    return events.join(targets, keys, "left_anti")


def installed(markets: DataFrame, segment: DataFrame) -> DataFrame:
    """The asked markets that a segment holds."""
    return markets.join(segment, "market", "left_semi")


def coverage(targets: DataFrame, evidence: DataFrame, keys: list[str], by: str) -> DataFrame:
    """covered and required targets: an acknowledgement counts at one venue, a data message at the other, so
    ``evidence`` holds the keys for which either was seen."""
    seen = evidence.select(*keys).distinct().withColumn("hit", F.lit(1))
    return targets.join(seen, keys, "left").groupBy(by).agg(F.count("hit").alias("covered"), F.count(F.lit(1)).alias("required"))


def market_status(subscriptions: DataFrame, pins: DataFrame, leases: DataFrame) -> DataFrame:
    """A market's subscription, whether it is pinned, and the consumer sessions that hold it."""
    held = leases.groupBy("market").agg(F.countDistinct("session").alias("leases"))
    pinned = pins.select("market").distinct().withColumn("pinned", F.lit(True))
    return subscriptions.join(pinned, "market", "left").join(held, "market", "left").select("market", "subscription", F.coalesce("pinned", F.lit(False)).alias("pinned"), F.coalesce("leases", F.lit(0)).cast("long").alias("leases"))


def reconciled(desired: DataFrame, current: DataFrame) -> DataFrame:
    """What brings the current set to the desired one: subscribing, removing or established for each market."""
    a, b = desired.select("market").distinct().withColumn("want", F.lit(1)), current.select("market").distinct().withColumn("have", F.lit(1))
    state = F.when(F.col("have").isNull(), "subscribing").when(F.col("want").isNull(), "removing").otherwise("established")
    return a.join(b, "market", "full_outer").select("market", state.alias("subscription"))


def lifecycle(subscription: Column, authority: Column) -> Column:
    """The status of a market from its subscription and the authority of its latest state: removed, rejected where it
    has no subscription, accepted before its first state, reconciling while it is subscribed, and live or stale."""
    reason = F.regexp_extract(authority, r"^Stale\((.*)\)$", 1)
    return (
        F.when(subscription.isNull(), "rejected").when(subscription == "removing", "removed")
        .when(authority.startswith("Stale"), F.concat(F.lit("stale("), F.lower(reason), F.lit(")")))
        .when((subscription == "established") & (authority == "Live"), "live").when(authority.isNull() & (subscription == "desired"), "accepted").otherwise("reconciling")
    )
