"""Add labelled anomalies to a daily cost table (detector evaluation).

Rows are addressed the way a generator that writes one row per stream per
day would number them: ``idx = date_rank * n_streams + stream_rank``. The
distinct dates (bounded by the calendar) and the distinct streams are ranked
and joined back; no row number over the rows is needed. A null key is a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costlens import fixed
from costlens.functions import columns as C
from costlens.operators.keyed import join_groups
from costlens.operators.positional import positional_index
from costlens.schema import S
from costlens.session import materialize


def _ranked(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Positions from 0 in the order of the keys, by the distributed index: there
    may be more streams than one task should sort."""
    return positional_index(df.withColumn("_all", F.lit(0)), ["_all"], list(keys), idx=out).drop("_all")


def perturb_labelled(daily: DataFrame, keys: Sequence[str] = S) -> DataFrame:
    """``daily`` has keys, date, cost_cents and had_anomaly. Returns keys,
    date, cost_cents (perturbed), cost, is_anomaly, anomaly_type."""
    # the daily frame feeds both rankings and the result: it is written once
    daily = materialize(daily, "daily-labels")
    dates = daily.select("date").distinct().withColumn(
        "_dr", F.row_number().over(Window.orderBy("date")) - 1)          # the calendar's days
    streams = materialize(_ranked(daily.select(*keys).distinct(), keys, "_sr"), "stream-ranks")
    n_streams = streams.agg(F.count(F.lit(1)).alias("_ns"))
    # anchor dates by rank (one row each)
    anchors = dates.agg(
        F.max(F.when(F.col("_dr") == fixed.SPIKE_DATE_INDEX, F.col("date"))).alias("_spike"),
        F.max(F.when(F.col("_dr") == fixed.CONTEXT_DATE_INDEX, F.col("date"))).alias("_ctx0"))
    sunday = F.date_add("_ctx0", F.pmod(F.lit(fixed.CONTEXT_WEEKDAY) - C.day_of_week("_ctx0"), F.lit(7)))
    # one-row constants joined on a literal key (both sides: one row)
    consts = (n_streams.withColumn("_k", F.lit(1))
              .join(anchors.select("_spike", sunday.alias("_ctx")).withColumn("_k", F.lit(1)), "_k"))
    # one row a day and one row a stream: AQE broadcasts them while they are small
    d = (join_groups(join_groups(daily, dates, ["date"]), streams, keys)
         .withColumn("_k", F.lit(1)).join(F.broadcast(consts), "_k", "inner"))
    idx = F.col("_dr") * F.col("_ns") + F.col("_sr")
    drift_i = F.col("_dr") - fixed.DRIFT_FIRST_INDEX
    is_spike = (F.col("date") == F.col("_spike")) & (F.pmod(idx, F.lit(fixed.SPIKE_MOD)) == 0)
    is_drift = ((drift_i >= 0) & (drift_i < fixed.DRIFT_DAYS)
                & (F.pmod(idx, F.lit(fixed.DRIFT_MOD)) == 0))
    is_ctx = F.col("date") == F.col("_ctx")
    factor = (F.when(is_ctx, F.lit(fixed.CONTEXT_FACTOR))
               .when(is_drift, F.lit(fixed.DRIFT_BASE) + drift_i * F.lit(fixed.DRIFT_STEP))
               .when(is_spike, F.lit(fixed.SPIKE_FACTOR)))
    kind = (F.when(is_ctx, "contextual").when(is_drift, "drift").when(is_spike, "spike"))
    cents = F.when(factor.isNotNull(), F.round(F.col("cost_cents") * factor).cast("long")) \
             .otherwise(F.col("cost_cents"))
    return d.select(
        *keys, "date", cents.alias("cost_cents"), (cents.cast("double") / 100).alias("cost"),
        F.when(factor.isNotNull(), 1).otherwise(F.col("had_anomaly")).cast("int").alias("is_anomaly"),
        F.coalesce(kind, F.when(F.col("had_anomaly") == 1, "spike").otherwise("none"))
        .alias("anomaly_type"))
