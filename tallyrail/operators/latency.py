"""Latency by histogram: quantiles are upper bounds of buckets, the maximum and the last sample are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exact import bucket_bound


def histogram(samples: DataFrame, key: str, micros: str) -> DataFrame:
    """key, ub and n: a mergeable aggregate with few rows for each key."""
    return samples.groupBy(key, bucket_bound(F.col(micros)).alias("ub")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(hist: DataFrame, key: str, per_mille: dict[str, int]) -> DataFrame:
    """Nearest rank: the first bucket whose running count reaches the share, for each named quantile in thousandths."""
    order = W.partitionBy(key).orderBy("ub")
    rows = hist.withColumns({"cum": F.sum("n").over(order), "total": F.sum("n").over(W.partitionBy(key))})
    found = [F.min(F.when(F.col("cum") * 1000 >= F.col("total") * q, F.col("ub"))).alias(name) for name, q in per_mille.items()]
    return rows.groupBy(key).agg(F.max("total").cast("long").alias("samples"), *found)


def latency_report(samples: DataFrame, key: str, micros: str, order: str, per_mille: dict[str, int] | None = None) -> DataFrame:
    """samples, quantile bounds, exact maximum and the last sample in ``order`` of each key."""
    bounds = quantiles(histogram(samples, key, micros), key, per_mille or {"p50": 500, "p99": 990, "p999": 999})
    exact = samples.groupBy(key).agg(F.max(micros).alias("max_us"), F.max_by(micros, order).alias("last_us"))
    return bounds.join(exact, key)
