"""Files and tables that runs leave. Paths may be of any store that Spark writes to."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _put(path: str, row: dict, flags: list[str]) -> None:
    """Create a file of one JSON object through the store's own client."""
    spark = SparkSession.active()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    create = jvm.java.util.EnumSet.noneOf(jvm.java.lang.Class.forName("org.apache.hadoop.fs.CreateFlag"))
    for flag in flags:
        create.add(getattr(jvm.org.apache.hadoop.fs.CreateFlag, flag))
    none = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0)
    out = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).create(target, create, none)
    try:
        out.write(bytearray(json.dumps(row, ensure_ascii=False, indent=2).encode()))
        out.hsync()
    finally:
        out.close()


def write_snapshot(row: dict, path: str) -> None:
    """Rewrite a small summary file: beside it first, then renamed over it, so that readers always see a whole one."""
    _put(f"{path}.tmp", row, ["CREATE", "OVERWRITE"])
    spark = SparkSession.active()
    fs = spark._jvm.org.apache.hadoop.fs
    rename = spark._sc._gateway.new_array(fs.Options.Rename, 1)
    rename[0] = fs.Options.Rename.OVERWRITE
    there = fs.Path(path)
    fs.FileContext.getFileContext(there.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.Path(f"{path}.tmp"), there, rename)


def write_report(row: dict, path: str) -> None:
    """Write a report once; a path that exists is an error."""
    try:
        _put(path, row, ["CREATE"])
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception):
            raise FileExistsError(path) from error
        raise


def publish(books: DataFrame, segment: str) -> None:
    """Published states of a batch, a folder for each shard; rows of a market lie together, so a reader of one market
    skips the others by the files' statistics."""
    books.repartition("shard", "market").sortWithinPartitions("market").write.mode("append").partitionBy("shard").parquet(segment)


def withdraw(segment: str) -> None:
    """Remove a segment, as a clean stop does."""
    spark = SparkSession.active()
    path = spark._jvm.org.apache.hadoop.fs.Path(segment)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def record(messages: DataFrame, path: str) -> None:
    """Raw frames as they came, one a line."""
    messages.select("frame").write.mode("append").text(path)


def report_row(head: dict, shards: DataFrame, families: DataFrame) -> dict:
    """The one object of a report: the fields of ``head``, a row a shard, and the rows of its stream's families. It is
    gathered here, as a run has few shards, and families have few names."""
    lists = families.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("family", "events", "p50_ub_us", "p99_ub_us", "max_ns"))).alias("families"))
    rows = shards.join(lists, "stream", "left").orderBy("shard").toJSON().collect()
    return head | {"shards": [json.loads(r) for r in rows]}
