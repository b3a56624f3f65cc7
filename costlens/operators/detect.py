"""Anomaly tiers that are plain Spark SQL: the window-only seasonal
residual (I2), the rolling-z statistical detector (I3 via F3 and D1), the
contamination cut (I5) and the ensemble vote (I12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costlens import fixed
from costlens.functions import columns as C
from costlens.operators import aggregates as A
from costlens.operators import windows as W
from costlens.operators.keyed import join_groups, join_stats
from costlens.schema import S
from costlens.session import materialize


def seasonal_residual(daily: DataFrame, keys: Sequence[str] = S,
                      period: int = fixed.STL_PERIOD) -> DataFrame:
    """residual = cost - trend - seasonal on the daily series, in cents.

    trend    = mean of the ``period`` rows centred on the day (edges: what exists)
    seasonal = mean detrended value of the weekday - mean detrended value
    Each mean is re-quantised to whole cents so later sums stay exact.
    The three windows share the stream partitioning: one shuffle, three sorts.
    """
    h = period // 2
    x = F.col("cost_cents")
    w_c = W.daily_window(keys).rowsBetween(-h, h)
    trend = F.round(F.sum(x).over(w_c).cast("double") / F.count(x).over(w_c)).cast("long")
    d = daily.withColumn("trend_cents", trend).withColumn("_dow", C.day_of_week("date"))
    det = F.col("cost_cents") - F.col("trend_cents")
    w_dow = Window.partitionBy(*keys, "_dow")
    w_all = Window.partitionBy(*keys)
    dow_mean = F.round(F.sum(det).over(w_dow).cast("double") / F.count(det).over(w_dow)).cast("long")
    all_mean = F.round(F.sum(det).over(w_all).cast("double") / F.count(det).over(w_all)).cast("long")
    d = d.withColumn("seasonal_cents", dow_mean - all_mean).drop("_dow")
    return d.withColumn("resid_cents", F.col("cost_cents") - F.col("trend_cents") - F.col("seasonal_cents"))


def score_days(daily_resid: DataFrame, keys: Sequence[str] = S,
               min_days: int = 2 * fixed.STL_PERIOD) -> DataFrame:
    """F3 + flag: rolling z of the residual, |z| > 3 flags the day. A stream
    with fewer than ``min_days`` days scores 0 everywhere (D6)."""
    z = W.rolling_z(daily_resid, "resid_cents", keys, out="_z", over="_over")
    z = z.withColumn("_short", F.count(F.lit(1)).over(Window.partitionBy(*keys)) < min_days)
    return z.select("*", F.when(F.col("_short"), F.lit(0.0)).otherwise(F.col("_z")).alias("stat_z_score"),
                    F.when(F.col("_short"), F.lit(0)).otherwise(F.col("_over")).alias("stat_is_anomaly")).drop("_z", "_over", "_short")


def day_scores(spend: DataFrame, keys: Sequence[str] = S) -> DataFrame:
    """E1 -> I2 -> F3 -> flag: one scored row per stream and day."""
    return score_days(seasonal_residual(A.daily_cost(spend, keys), keys), keys)


#: Days of all streams that are broadcast in any case, some 20 MB.
DAYS = 200_000


def broadcast_day_score(rows: DataFrame, scores: DataFrame, keys: Sequence[str] = S,
                        cols: Sequence[str] = ("stat_z_score", "stat_is_anomaly")) -> DataFrame:
    """Put each (stream, day) score on every row of that day.

    An equi join on (stream, date). The day table is bounded by streams x
    calendar days; it is written and broadcast up to ``DAYS`` rows, so the rows
    stay where they are. A larger one is joined by its size.
    """
    sc = materialize(scores.select(*keys, F.col("date").alias("_date"), *cols), "group-stats")
    few = sc.limit(DAYS + 1).count() <= DAYS
    j = join_groups(rows.withColumn("_date", C.to_day("timestamp")), F.broadcast(sc) if few else sc,
                    [*keys, "_date"], "left").drop("_date")
    return j.fillna(0, subset=list(cols))


def stat_detector(spend: DataFrame, keys: Sequence[str] = S) -> DataFrame:
    """I3 (window version): every spend row with its day's z and flag."""
    return broadcast_day_score(spend, day_scores(spend, keys), keys)


def contamination_flags(df: DataFrame, scores: dict[str, str], keys: Sequence[str] = S,
                        contamination: float = fixed.IFOREST_CONTAMINATION, written: bool = False) -> DataFrame:
    """I5 for several scores at once ({flag: score}): each flags rows strictly
    above the stream's (1 - contamination) percentile of its score (exact,
    distributed percentile). The scored frame feeds the histograms and the
    comparison: it is written once, unless the caller has ``written`` it."""
    df = df if written else materialize(df, "scored-rows")
    cuts = None
    for flag, score in scores.items():
        th = A.exact_percentile(df, score, 1.0 - contamination, keys, out=f"_th_{flag}", written=True)
        cuts = th if cuts is None else join_groups(cuts, th, keys, "left")
    # one row per stream: joined to the rows once for all scores
    j = join_stats(df, cuts, keys, "left")
    return j.withColumns({flag: (F.col(score) > F.col(f"_th_{flag}")).cast("int") for flag, score in scores.items()}).drop(
        *[f"_th_{flag}" for flag in scores])


def contamination_flag(df: DataFrame, score: str, keys: Sequence[str] = S,
                       contamination: float = fixed.IFOREST_CONTAMINATION,
                       out: str = "ml_is_anomaly", written: bool = False) -> DataFrame:
    """Flag rows whose score is strictly above the stream's
    (1 - contamination) percentile."""
    return contamination_flags(df, {out: score}, keys, contamination, written)


def ensemble_vote(df: DataFrame, stat: str = "stat_is_anomaly", ml: str = "ml_is_anomaly",
                  dl: str = "dl_is_anomaly", out: str = "ensemble_is_anomaly") -> DataFrame:
    """stat = 1 -> 1; else ml = 1 and dl = 1 -> 1; else 0."""
    return df.withColumn(out, F.when(F.col(stat) == 1, 1)
                         .when((F.col(ml) == 1) & (F.col(dl) == 1), 1).otherwise(0))
