"""Running sums and numbers over keys of any size, without a window over a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same ``keys`` before each row,
    in order of (``bucket``, ``order``). Sums go over buckets first, then within each, so that no
    task sees more of a key than one bucket's rows or one row a bucket. Buckets must not be NULL and
    their rows few; ``order`` must be unique in a bucket."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(base, [*keys, bucket])
        .withColumn(name, F.col("_base") + F.col("_inside"))
        .drop("_base", "_inside")
    )
