"""Control of a running set of markets: status, add and remove, with the exit codes of the command line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import routing, selection

#: Exit codes: all applied, a market was rejected, a bounded queue was full and nothing was applied.
APPLIED, REJECTED, FULL = 0, 3, 4
#: Exit codes of the engine itself: stopped by request, start-up failed, bad settings, a shard stopped.
STOPPED, STARTUP_FAILED, BAD_SETTINGS, SHARD_STOPPED = 0, 1, 2, 3


def exit_code(error: BaseException | None = None, shards: DataFrame | None = None) -> int:
    """The exit code of an engine that ended with ``error``, if any. ``shards`` has the last state of each (shard,
    running), where it got as far as that."""
    if error is not None and getattr(error, "code", None) != BAD_SETTINGS:
        return STARTUP_FAILED if shards is None else SHARD_STOPPED
    if error is not None:
        return BAD_SETTINGS
    return STOPPED if shards is None or shards.filter("NOT running").isEmpty() else SHARD_STOPPED


class Engine:
    """Holds the desired set as a DataFrame. ``known`` are the markets that a venue lists."""

    def __init__(self, desired: DataFrame, known: DataFrame, queue: int = 1024):
        self.desired, self.known, self.queue = desired.select("market"), known.select("market"), queue

    def change(self, asked: DataFrame, add: bool) -> tuple[DataFrame | None, int]:
        """(answers of each market, exit code). A request of more markets than the queue takes changes nothing."""
        if asked.limit(self.queue + 1).count() > self.queue:
            return None, FULL
        answers = selection.answers(self.desired, asked, self.known, add)
        done = answers.filter("reason IS NULL")
        self.desired = selection.added(self.desired, done) if add else selection.removed(self.desired, done)
        return answers, APPLIED if answers.filter("reason IS NOT NULL").isEmpty() else REJECTED

    def add(self, asked: DataFrame) -> tuple[DataFrame | None, int]:
        return self.change(asked, True)

    def remove(self, asked: DataFrame) -> tuple[DataFrame | None, int]:
        return self.change(asked, False)

    def status(self, current: DataFrame, pins: DataFrame, leases: DataFrame, books: DataFrame) -> DataFrame:
        """One row per market: subscription, pinned, leases and the latest published state."""
        latest = books.groupBy("market").agg(F.max(F.struct("revision", "authority", "continuity_epoch")).alias("b"))
        rows = routing.market_status(routing.reconciled(self.desired, current), pins, leases)
        return rows.join(latest, "market", "left").select("market", "subscription", routing.lifecycle(F.col("subscription"), F.col("b.authority")).alias("status"), "pinned", "leases", F.col("b.revision").alias("revision"), F.col("b.authority").alias("authority"), F.col("b.continuity_epoch").alias("continuity_epoch"))
