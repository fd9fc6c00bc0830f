"""The tape: one row per admitted message, and the tables counted from it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("lines"), F.sum("events").cast("long").alias("events"), F.sum("bytes").cast("long").alias("bytes")]


def labelled(batches: DataFrame) -> DataFrame:
    """Family and market of a message are those of its first event; all its events count under that family.

    ``batches`` has an array ``events`` of struct(family, market, ...). A message without events has neither.
    """
    first = F.get("events", 0)
    return batches.withColumns({"family": first["family"], "market": first["market"], "n_events": F.size("events").cast("long")})


def tape_table(tape: DataFrame, *keys: str) -> DataFrame:
    """lines, events and bytes of each key."""
    return tape.groupBy(*keys).agg(*counts())


def printed(table: DataFrame) -> DataFrame:
    """A table's rows in the order in which it is printed: by venue, then family."""
    return table.orderBy("venue", "family")


def tape_with_total(tape: DataFrame) -> DataFrame:
    """The table by venue and family, and its total line, where both are null."""
    rows = tape.rollup("venue", "family").agg(*counts(), F.grouping_id().alias("level"))
    return rows.filter("level IN (0, 3)").drop("level")


def tape_intervals(tape: DataFrame, seconds: int = 10, *keys: str) -> DataFrame:
    """Tables of ``seconds`` counted from the tape's first line. An interval without lines prints nothing."""
    start = tape.agg(F.min("t_ns").alias("start_ns"))
    slot = F.expr(f"(t_ns - start_ns) div {seconds * 1_000_000_000}")  # whole numbers: doubles can't hold nanoseconds
    return tape.crossJoin(F.broadcast(start)).withColumn("slot", slot).groupBy("slot", *keys).agg(*counts())  # one row


def follow(tape: DataFrame, market) -> DataFrame:
    return tape.filter(F.col("market") == F.lit(market))


def window_gate(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Only events inside the measured window count."""
    return events.filter((F.col("t_ns") >= start) & (F.col("t_ns") < end))


#: Ticks of a block whose lines one step folds.
BLOCK_TICKS = 60_000


def bounded_tape(tape: DataFrame, capacity: int = 2048, per_tick: int = 1, tick_ns: int = 1_000_000, block_ticks: int = BLOCK_TICKS) -> DataFrame:
    """``tape`` with ``queued`` and ``dropped``: the lines of its stream's queue once a line has come, and whether the
    line found ``capacity`` lines there and was dropped. The queue begins empty at the stream's first line and gives
    up ``per_tick`` lines at each later tick. Lines come in order of t_ns and seq; dropped lines never queue.

    What a line does to the queue's length x is min(max(x + a, low), high), and such steps combine to steps of the
    same kind. So each block of a stream is reduced to one step, the few blocks of a stream give each other the length
    that they begin with, and then every block is folded on its own: a stream of many lines is spread over tasks, which
    read their blocks as a sorted stream and hold no block whole.
    """
    names = tape.columns
    first = tape.groupBy("stream").agg(F.min("t_ns").alias("first_"))
    rows = tape.join(first, "stream").withColumn("slot_", F.expr(f"(t_ns - first_) div {tick_ns}")).withColumn("block_", F.expr(f"slot_ div {block_ticks}"))
    rows = rows.select(*names, "slot_", "block_").repartition("stream", "block_").sortWithinPartitions("stream", "block_", "t_ns", "seq")

    def folded(batches: Iterator[pa.RecordBatch], begin, line, end) -> Iterator[pa.RecordBatch]:
        """Walk the sorted blocks: ``begin`` gives the state of a block, ``line`` the next one and a value."""
        now, state, slot = None, None, 0
        for batch in batches:
            values = []
            streams, blocks, slots = (batch.column(c).to_pylist() for c in ("stream", "block_", "slot_"))
            for k, key in enumerate(zip(streams, blocks, strict=True)):
                if key != now:
                    if now is not None:
                        yield from end(now, state, slot)
                    now, state, slot = key, begin(batch, k), key[1] * block_ticks
                state, value = line(state, (slots[k] - slot) * per_tick)
                slot = slots[k]
                values.append(value)
            yield from end(None, values, batch)
        if now is not None:
            yield from end(now, state, slot)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def line(state, drained):
            return then(then(state, (-drained, 0, capacity)), (1, 1, capacity)), None

        def end(key, state, slot):
            if key is not None:
                a, low, high = then(state, (((slot - (key[1] + 1) * block_ticks)) * per_tick, 0, capacity))
                yield pa.record_batch([pa.array([x]) for x in (*key, a, low, high)], names=["stream", "block_", "a", "low", "high"])

        return folded(batches, lambda batch, k: (0, 0, capacity), line, end)

    def begins(table: pa.Table) -> pa.Table:
        table = table.sort_by("block_")
        x, at, found = 0, None, []
        for block, a, low, high in zip(*(table.column(c).to_pylist() for c in ("block_", "a", "low", "high")), strict=True):
            if at is not None:
                x = max(0, x - (block - at - 1) * block_ticks * per_tick)
            found.append(x)
            x, at = min(max(x + a, low), high), block
        return table.select(["stream", "block_"]).append_column("begin_", pa.array(found, pa.int64()))

    kind = tape.schema["stream"].dataType.simpleString()
    reduced = rows.select("stream", "block_", "slot_").mapInArrow(steps, f"stream {kind}, block_ long, a long, low long, high long")
    start = reduced.groupBy("stream").applyInArrow(begins, f"stream {kind}, block_ long, begin_ long")  # a row a block
    held = rows.join(start, ["stream", "block_"]).select(*names, "slot_", "block_", "begin_")
    held = held.repartition("stream", "block_").sortWithinPartitions("stream", "block_", "t_ns", "seq")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def line(x, drained):
            x = max(0, x - drained)
            full = x >= capacity
            return (x if full else x + 1), ((x if full else x + 1), full)

        def end(key, values, batch):
            if key is None and values:
                columns = [batch.column(c) for c in names]
                yield pa.record_batch([*columns, pa.array([q for q, _ in values], pa.int64()), pa.array([d for _, d in values])], names=[*names, "queued", "dropped"])

        return folded(batches, lambda batch, k: batch.column("begin_")[k].as_py(), line, end)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tape.schema)
    return held.mapInArrow(marked, f"{fields}, queued long, dropped boolean")


def then(one: tuple[int, int, int], two: tuple[int, int, int]) -> tuple[int, int, int]:
    """The step (a, low, high) that x -> min(max(x + a, low), high) of ``one`` and then of ``two`` make together."""
    (a, low, high), (b, least, most) = one, two
    return a + b, min(max(low + b, least), most), min(max(high + b, least), most)
