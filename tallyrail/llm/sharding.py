"""Rendezvous sharding of stable record keys over weighted shards.

Every (key, shard) pair gets a score from a hash, and a record goes to the shard with the least score. A further
shard can only win records for itself, so growing from n to n + 1 shards moves about 1 / (n + 1) of the rows and
moves none between old shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table

#: Rows that one numbering block holds on average.
BLOCK_ROWS = 50_000


def rendezvous(key: Column, weights: list[float], first: int = 0) -> Column:
    """The winner as struct(score, shard) of the shards ``first`` .. ``first + len(weights) - 1``.

    The score of weight w is -ln(u) / w for a uniform u in (0, 1) made of 53 bits of xxhash64(key, shard), so a
    shard wins in proportion to its weight. Equal scores go to the smaller shard. A null key is a key like any other.
    """
    weight = F.array(*[F.lit(float(w)) for w in weights])

    def scored(i: Column) -> Column:
        shard = i + F.lit(first)
        uniform = (F.shiftrightunsigned(F.xxhash64(key, shard), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(uniform) / F.get(weight, i)).alias("score"), shard.alias("shard"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), scored))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None) -> DataFrame:
    """Shard every row by its key: key, size, text_crc32, shard, slot and the shard after one more of weight 1.

    Size is the text's UTF-8 bytes plus 16; a null text has none and the CRC of empty text. Slots count from 0
    without gaps in each shard, in order of blocks, key, CRC and size. Rows are numbered in blocks of about
    ``BLOCK_ROWS``: one aggregation counts each block, a running sum over the counts gives where a block begins, and
    only the rows of one block meet in a task. Repeated rows all get a slot; other columns are left out.
    """
    weights = weights or [1.0] * 40
    blocks = max(1, -(-docs.count() // (BLOCK_ROWS * len(weights))))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + F.lit(16)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("best"),
        rendezvous(F.col(key), [1.0], len(weights)).alias("more"),
    ).select(
        "doc_id", "size", "text_crc32", F.col("best.shard").alias("shard"),
        F.when(F.col("more.score") < F.col("best.score"), F.col("more.shard")).otherwise(F.col("best.shard")).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("slot")), F.lit(blocks)).alias("block"),
    )
    begins = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "begin", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    inside = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("inside", inside).join(begins.drop("n"), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("begin") + F.col("inside")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents"))
