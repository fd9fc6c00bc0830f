"""What a running stream leaves: published books and mutations, and a summary that is rewritten each period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sinks.files import write_snapshot


def publishing(states: DataFrame, segment: str, shards: int = 1) -> DataStreamWriter:
    """Write the rows of ``book_stream`` to ``segment``: states and mutations apart, a folder for each micro-batch and
    shard. A batch that is run again replaces its own folder, so a restart publishes nothing twice."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("shard", F.pmod(F.xxhash64("market"), F.lit(shards))).persist()
        for what, kept in (("states", "what = 'state'"), ("mutations", "what = 'mutation'"), ("resolutions", "what = 'resolution'")):
            rows.filter(kept).drop("what").repartition("shard", "market").sortWithinPartitions("market", "seq", "position").write.mode("overwrite").partitionBy("shard").parquet(f"{segment}/{what}/batch={number}")
        rows.unpersist()

    return states.writeStream.outputMode("append").foreachBatch(put)


def summarising(totals: DataFrame, path: str, seconds: int = 10) -> DataStreamWriter:
    """Rewrite a summary file every ``seconds`` from a stream in complete mode that has few rows, one for each venue
    and family. A reader always sees a whole file."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.orderBy(*batch.columns[:2]).collect()
        write_snapshot({"batch": number, "rows": [r.asDict() for r in rows]}, path)

    return totals.writeStream.outputMode("complete").trigger(processingTime=f"{seconds} seconds").foreachBatch(put)
