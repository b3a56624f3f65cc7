"""Order statistics of every group by histograms, without a sort of the rows.

A target is a rank in a group. The first pass counts the values of each group by
sign and power of two (at most some four thousand counts a group) and finds the
bucket that holds each target. Each further pass looks only at the values inside
such buckets, cuts the bucket's own range into ``CUTS`` equal parts and counts
again. A bucket whose least and greatest value are equal is the answer, so ties,
however many, end at once. A bucket spans a factor of two at most, so a double's
52 bits are used up after four such passes; two or three are usual.

Only counts are shuffled, added up in the tasks that read the values: a group
with a third of all rows costs as many counts as any other. The window that turns
counts into ranks sees at most ``CUTS`` rows of a group and target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.operators.keyed import join_groups
from costlens.session import materialize

CUTS = 1 << 14
#: Above the exponents of all doubles.
_SHIFT, _INFINITE, _NAN = 2000, 10_000, 20_000


def magnitude(v: Column) -> Column:
    """A whole number that grows with ``v``: its sign and power of two. The
    logarithm is monotonic, so no value gets before a lesser one."""
    size = F.abs(v)
    power = F.floor(F.log2(size)).cast("int") + F.lit(_SHIFT)
    power = F.when(size == float("inf"), F.lit(_INFINITE)).otherwise(power)
    return F.when(F.isnan(v), F.lit(_NAN)).when(v == 0, F.lit(0)).when(v < 0, -power).otherwise(power).cast("int")


def _found(hist: DataFrame, targets: DataFrame, scope: Sequence[str], bucket: str, keys: Sequence[str]) -> DataFrame:
    """The targets, with rank and range now those within their bucket."""
    w = Window.partitionBy(*scope).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    upto = hist.withColumn("_upto", F.sum("_c").over(w)).select(
        *scope, "_upto", (F.col("_upto") - F.col("_c")).alias("_below"), F.col("_min").alias("_a"), F.col("_max").alias("_b"))
    hit = join_groups(targets, upto, scope).where((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_upto")))
    return hit.select(*keys, "_which", (F.col("_rank") - F.col("_below")).alias("_rank"),
                      F.col("_a").alias("_lo"), F.col("_b").alias("_hi"))


def _counted(v: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("_c"), F.min(v).alias("_min"), F.max(v).alias("_max")]


def first_histogram(values: DataFrame, keys: Sequence[str], value: str = "_v") -> DataFrame:
    """The first pass: counts of each group by sign and power of two."""
    v = F.col(value)
    return values.groupBy(*keys, magnitude(v).alias("_bucket")).agg(*_counted(v))


def select_ranks(values: DataFrame, targets: DataFrame, keys: Sequence[str], value: str = "_v", cuts: int = CUTS, *,
                 hist: DataFrame | None = None) -> DataFrame:
    """(keys, _which, _value): the value at each target's rank.

    ``values`` is (keys, value) without nulls and is read once a pass, so hand
    in a written table; ``targets`` is (keys, _which, _rank) with ranks from 0
    to the group's count less one. -0.0 equals 0.0 and NaN is the greatest.
    ``hist`` is ``first_histogram``, if the caller has written it."""
    keys = list(keys)
    v = F.col(value)
    hist = first_histogram(values, keys, value) if hist is None else hist
    state = materialize(_found(hist, targets, keys, "_bucket", keys), "rank-targets")
    done = []
    while True:
        done.append(state.where("_lo <=> _hi"))
        open_ = state.where("NOT (_lo <=> _hi)")
        if not open_.limit(1).count():
            break
        # two targets of a group often share their bucket: look at it once
        spans = open_.select(*keys, "_lo", "_hi").distinct()
        inside = join_groups(values, spans, keys).where((v >= F.col("_lo")) & (v <= F.col("_hi")))
        cut = F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(cuts - 1))).cast("int")
        hist = inside.groupBy(*keys, "_lo", "_hi", cut.alias("_bucket")).agg(*_counted(v))
        scope = [*keys, "_lo", "_hi"]
        state = materialize(_found(hist, open_, scope, "_bucket", keys), "rank-targets")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*keys, "_which", F.col("_lo").alias("_value"))
