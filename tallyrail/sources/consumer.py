"""A reader of one market's published states and mutations that never misses a loss of continuity."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from .files import attach


class ContinuityLost(RuntimeError):
    """The stream can't prove that every mutation was delivered in order; attach anew."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


class Consumer:
    """``state`` is the latest published state. ``next_event`` gives the mutations after it in order, or None if there
    is no more yet. After a new epoch, or when more than ``capacity`` mutations behind the head, it raises until
    ``reattach`` has replaced the state. Each poll reads at most ``batch`` mutations of the one market."""

    def __init__(self, spark: SparkSession, states: str, mutations: str, market: str, capacity: int = 4096, batch: int = 256):
        self.spark, self.states, self.mutations, self.market = spark, states, mutations, market
        self.capacity, self.batch = capacity, batch
        self.held: deque[Row] = deque()
        self.lost: str | None = None
        self.state = self.reattach()

    def reattach(self) -> Row:
        rows = attach(self.spark, self.states, self.market)
        self.state = rows.orderBy(F.desc("revision")).first()
        self.epoch = self.state["continuity_epoch"]
        newest = self.changes().filter((F.col("continuity_epoch") == self.epoch) & (F.col("revision") <= self.state["revision"]))
        self.position = newest.agg(F.max("position")).first()[0] or 0
        self.held.clear()
        self.lost = None
        return self.state

    def changes(self):
        return self.spark.read.parquet(self.mutations).filter(F.col("market") == self.market)

    def next_event(self) -> Row | None:
        if self.lost is None and not self.held:
            own = F.col("continuity_epoch") == self.epoch
            news = self.changes().filter((F.col("continuity_epoch") > self.epoch) | (own & (F.col("position") > self.position)))
            later, head = news.agg(F.max("continuity_epoch"), F.max(F.when(own, F.col("position")))).first()
            if later is None:
                return None
            if later > self.epoch:
                self.lost = "Reconnect"
            elif head - self.position > self.capacity:
                self.lost = "Overrun"
            else:
                self.held.extend(news.orderBy("position").limit(self.batch).collect())
                if self.held and self.held[0]["position"] != self.position + 1:
                    self.lost = "Gap"
        if self.lost is not None:
            raise ContinuityLost(self.lost)
        if not self.held:
            return None
        event = self.held.popleft()
        self.position = event["position"]
        return event
