"""Dense positions for rows inside hot keys, without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_rank_in(df: DataFrame, key: str, tie: list[Column], name: str = "rank", buckets: int = 64) -> DataFrame:
    """``df`` with a gapless position from 0 among the rows of ``key``.

    Rows of a key are dealt into ``buckets`` by a hash of ``tie``; bucket
    counts become offsets and only one bucket is numbered by one task. ``df``
    is read twice, so hand in a written table. A null key is a key.
    """
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(*tie), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(F.col(key).alias("__k"), F.col("__b").alias("__kb")).agg(F.count(F.lit(1)).alias("__n"))
    off = counts.withColumn("__off", F.sum("__n").over(Window.partitionBy("__k").orderBy("__kb")) - F.col("__n"))
    numbered = dealt.withColumn("__r", F.row_number().over(Window.partitionBy(key, "__b").orderBy(*tie)) - 1)
    return (numbered.join(off.drop("__n"), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__b") == F.col("__kb")))
            .withColumn(name, (F.col("__off") + F.col("__r")).cast("long"))
            .drop("__b", "__k", "__kb", "__off", "__r"))
