"""Generation fence and readiness over streams, with the rules of ``operators.health``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.health import READY_SECONDS

FENCED = "connection string, seq long, generation long, stale boolean"
OPENED = "run string, opened long, by string"


class Fence(StatefulProcessor):
    """Per connection: the highest generation so far. Rows of a micro-batch are taken in order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.highest = handle.getValueState("generation", "generation long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        before = self.highest.get()[0] if self.highest.exists() else None
        highest = batch["generation"].cummax()
        if before is not None:
            highest = highest.clip(lower=before)
        self.highest.update((int(highest.iloc[-1]),))
        yield pd.DataFrame({"connection": key[0], "seq": batch["seq"], "generation": batch["generation"], "stale": batch["generation"] < highest})

    def close(self) -> None:
        pass


class Readiness(StatefulProcessor):
    """Per run: the start, since when all connections are healthy, and whether the window has opened."""

    def __init__(self, ready: int, timeout: int | None):
        self.ready, self.timeout = ready, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", "start long, since long, opened boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("at", kind="stable")
        start, since, opened = self.state.get() if self.state.exists() else (int(batch["at"].iloc[0]), None, False)
        out = []
        for at, ok in zip(batch["at"].tolist(), batch["ok"].tolist(), strict=True):
            if opened:
                break
            late = None if self.timeout is None else start + self.timeout
            since = (at if since is None else since) if ok else None
            if since is not None and at - since >= self.ready and (late is None or since + self.ready <= late):
                out, opened = [(key[0], since + self.ready, "readiness")], True
            elif late is not None and at >= late:
                out, opened = [(key[0], late, "timeout")], True
        self.state.update((start, since, opened))
        yield pd.DataFrame(out, columns=["run", "opened", "by"])

    def close(self) -> None:
        pass


def fence_stream(events: DataFrame) -> DataFrame:
    """connection, seq, generation and stale of each event. A connection's rows must come in order across
    micro-batches; inside one they are sorted. Needs the RocksDB state store."""
    return events.select("connection", "seq", "generation").groupBy("connection").transformWithStateInPandas(Fence(), FENCED, "Append", "none")


def readiness_stream(health: DataFrame, ready: int = READY_SECONDS, timeout: int | None = None) -> DataFrame:
    """run, opened and by, once for each run, as soon as a row of (run, at, ok) shows that the window has opened: by
    ``ready`` seconds of unbroken health, or by ``timeout``. A run whose last row comes before the timeout stays open,
    where the batch operator, which sees the whole run, gives the timeout. Needs the RocksDB state store."""
    return health.select("run", "at", "ok").groupBy("run").transformWithStateInPandas(Readiness(ready, timeout), OPENED, "Append", "none")
