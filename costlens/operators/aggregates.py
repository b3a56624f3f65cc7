"""Aggregations (E1-E14). All are partial + final aggregates in Spark
(map-side combine before the shuffle); sums of money run on decimals
so they are independent of row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.functions import columns as C
from costlens.operators.keyed import join_groups
from costlens.operators.rankselect import first_histogram, select_ranks
from costlens.schema import S
from costlens.session import materialize


def daily_cost(spend: DataFrame, keys: Sequence[str] = S) -> DataFrame:
    """Cost per stream and day."""
    return (spend.groupBy(*keys, C.to_day("timestamp").alias("date"))
                 .agg(C.sum_cents("cost").alias("cost_cents"),
                      F.count(F.lit(1)).alias("n_rows"),
                      F.sum(C.exact("cost")).cast("double").alias("cost")))


def daily_cost_flag(spend: DataFrame, keys: Sequence[str] = S) -> DataFrame:
    """Cost and any-label flag per stream and day."""
    return (spend.groupBy(*keys, C.to_day("timestamp").alias("date"))
                 .agg(C.sum_cents("cost").alias("cost_cents"),
                      F.max("is_anomaly").cast("int").alias("had_anomaly"),
                      F.sum(C.exact("cost")).cast("double").alias("cost")))


def confusion(df: DataFrame, flag: str, label: str = "is_anomaly",
              keys: Sequence[str] = ()) -> DataFrame:
    """TP / FP / FN / TN of a 0/1 flag against a 0/1 label."""
    y, p = F.col(label) == 1, F.col(flag) == 1
    return df.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def evaluate(df: DataFrame, flags: Sequence[str], label: str = "is_anomaly", keys: Sequence[str] = ()) -> DataFrame:
    """E4-E6 for every tier in one pass: the flags are unpivoted into (tier,
    flag), and grouping sets give each tier over all rows (``is_total`` 1, keys
    null) and, with ``keys``, per group. Ratios are 0 where undefined; a row
    whose label or flag is null counts as not labelled or not flagged."""
    y, p = F.coalesce(F.col("_y") == 1, F.lit(False)), F.coalesce(F.col("_t._p") == 1, F.lit(False))
    long = df.select(*keys, F.col(label).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("tier"), F.col(f).alias("_p")) for f in flags])).alias("_t"))
    long = long.withColumn("tier", F.col("_t.tier"))
    counts = [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
              F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")]
    if keys:
        g = long.groupingSets([["tier"], ["tier", *keys]], "tier", *keys).agg(F.grouping(keys[0]).cast("int").alias("is_total"), *counts)
    else:
        g = long.groupBy("tier").agg(F.lit(1).alias("is_total"), *counts)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a.cast("double") / b).otherwise(0.0)
    return g.select("tier", *keys, "is_total", "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"),
                    ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                    (tp + fn).alias("true_anomalies"), tp.alias("caught"),
                    (tp.cast("double") / F.greatest(F.lit(1), tp + fn) * 100).alias("rate"))


def precision_recall_f1(df: DataFrame, flags: Sequence[str], label: str = "is_anomaly") -> DataFrame:
    """E5: per flag column, precision/recall/F1 with 0 where undefined, in the
    one pass of ``evaluate``."""
    return evaluate(df, flags, label).select("tier", "tp", "fp", "fn", "precision", "recall", "f1")


def detection_rate(df: DataFrame, flags: Sequence[str], label: str = "is_anomaly") -> DataFrame:
    """Caught / max(1, injected) x 100 for each flag."""
    y = F.col(label) == 1
    aggs = [F.count_if(y).alias("true_anomalies")]
    aggs += [F.count_if(y & (F.col(f) == 1)).alias(f"caught_{f}") for f in flags]
    g = df.agg(*aggs)
    return g.select("true_anomalies", *[
        F.col(f"caught_{f}") for f in flags], *[
        (F.col(f"caught_{f}").cast("double") / F.greatest(F.lit(1), F.col("true_anomalies")) * 100)
        .alias(f"rate_{f}") for f in flags])


def wmape(df: DataFrame, actual: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """sum|y - yhat| / sum|y|, 0 when the denominator is 0. Inputs are
    money; errors are summed in cents."""
    err = F.sum(F.abs(C.cents(actual) - C.cents(pred)))
    den = F.sum(F.abs(C.cents(actual)))
    return df.groupBy(*keys).agg(err.alias("abs_error_cents"), den.alias("abs_actual_cents")) \
        .withColumn("wmape", F.when(F.col("abs_actual_cents") == 0, F.lit(0.0))
                    .otherwise(F.col("abs_error_cents").cast("double") / F.col("abs_actual_cents")))


def residual_std(df: DataFrame, actual: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Population std of (actual - prediction), from cents."""
    r = C.cents(actual) - C.cents(pred)
    g = df.groupBy(*keys).agg(F.count(r).alias("n"), F.sum(r).alias("s"),
                              F.sum(r.cast("decimal(38,0)") * r.cast("decimal(38,0)")).alias("q"))
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    num = n.cast("decimal(38,0)") * q - s.cast("decimal(38,0)") * s.cast("decimal(38,0)")
    return g.select(*keys, "n", F.when(n > 0, F.sqrt(C.dec_to_double(num) / (n * n * 10000)))
                    .alias("residual_std"))


def exact_percentile(df: DataFrame, value: str, p: float, keys: Sequence[str] = (),
                     out: str = "threshold", approx_accuracy: int | None = None,
                     written: bool = False) -> DataFrame:
    """Linear-interpolated percentile per group, exact and distributed.

    ``percentile()`` would buffer a whole group in one task, and a sort would
    put all rows of a tied value in one. The two order statistics around rank
    (n - 1) * p are found by histograms instead (``rankselect``): only counts
    are shuffled. Null values don't count; a group without values has no row.
    ``df`` is read several times, so its values are written first unless it is
    ``written`` already. A null key is a group.

    ``approx_accuracy`` instead returns a sketch's value, for callers that
    accept a rank error of about 1/accuracy."""
    keys = list(keys)
    if approx_accuracy:
        return df.groupBy(*keys).agg(
            F.percentile_approx(F.col(value).cast("double"), p, approx_accuracy).alias(out))
    alone = not keys
    if alone:
        df, keys, written = df.withColumn("_all", F.lit(0)), ["_all"], False
    vals = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    vals = vals if written else materialize(vals, "percentile-values")
    pos = (F.col("_n") - 1).cast("double") * F.lit(p)
    # the first histogram also counts the groups
    hist = materialize(first_histogram(vals, keys), "percentile-counts")
    n = hist.groupBy(*keys).agg(F.sum("_c").alias("_n")).select(*keys, pos.alias("_rk"))
    n = materialize(n, "percentile-ranks")
    targets = n.select(*keys, F.explode(F.array(
        F.struct(F.lit("lo").alias("_which"), F.floor("_rk").alias("_rank")),
        F.struct(F.lit("hi").alias("_which"), F.ceil("_rk").alias("_rank")))).alias("_t")).select(*keys, "_t.*")
    found = select_ranks(vals, targets, keys, hist=hist).groupBy(*keys).agg(
        F.max(F.when(F.col("_which") == "lo", F.col("_value"))).alias("_x"),
        F.max(F.when(F.col("_which") == "hi", F.col("_value"))).alias("_y"))
    a, b = F.col("_x"), F.col("_y")
    res = join_groups(n, found, keys).select(
        *keys, (a + (b - a) * (F.col("_rk") - F.floor("_rk"))).alias(out))
    return res.drop("_all") if alone else res


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 value_cols: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key wins (max_by over a
    struct: a partial aggregate, no sort of the group)."""
    st = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_v_{c}") for c in value_cols])
    g = df.groupBy(*keys).agg(F.max(st).alias("_last"))
    return g.select(*keys, *[F.col(f"_last._v_{c}").alias(c) for c in value_cols])


def minmax_stats(df: DataFrame, features: Sequence[str], keys: Sequence[str] = S) -> DataFrame:
    """Per-feature min and max per stream."""
    aggs: list[Column] = []
    for f in features:
        aggs += [F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max")]
    return df.groupBy(*keys).agg(*aggs)
