"""Random points for trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import tag_column


def random_points(spark: SparkSession, n: int, metrics: dict[str, tuple[float, float]], tags: dict[str, str] | None = None, seed: int = 0) -> DataFrame:
    """Points of each metric at timestamps 0 to n - 1, with values between the metric's bounds."""
    rows = spark.range(n).select(F.col("id").alias("timestamp"), F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    value = F.coalesce(*(F.when(F.col("metric") == m, low + (high - low) * F.rand(seed + k)) for k, (m, (low, high)) in enumerate(metrics.items())))
    return rows.select("timestamp", "metric", *(F.lit(v).alias(tag_column(k)) for k, v in (tags or {}).items()), value.alias("value"))
