"""Tape tables over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tape import counts


def windows(tape: DataFrame, seconds: int = 10, late: str = "0 seconds") -> DataFrame:
    """Tumbling tables by venue and family. A table is complete, and comes out in append mode, when a later line has
    moved the watermark past it; a silent feed prints nothing."""
    at = F.timestamp_micros(F.floor(F.col("t_ns") / 1000))
    rows = tape.withColumn("at", at).withWatermark("at", late)
    return rows.groupBy(F.window("at", f"{seconds} seconds").alias("slot"), "venue", "family").agg(*counts()).select(F.col("slot.start").alias("start"), "venue", "family", "lines", "events", "bytes")


def since_start(tape: DataFrame) -> DataFrame:
    """Cumulative table, for complete mode."""
    return tape.groupBy("venue", "family").agg(*counts())
