"""Tenant-scoped reads and the dashboard's data work (C1, C2, C4, C5, C7,
C10, D4, E10, E11, E12, B12).

Every read takes literal parameters (tenant, stream, dates), so the
predicates reach the Parquet scan (partition pruning on
``organization_id`` when the table is partitioned, row-group pruning on
the rest). Tables that are loaded repeatedly are read through
``sources/versions.py``. The timeline merge is a union plus one small aggregate;
the history cut-off is a one-row aggregate joined on a literal key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens import fixed
from costlens.functions import columns as C
from costlens.operators import aggregates as A
from costlens.schema import S

SPEND_API_COLUMNS = ["timestamp", "cloud_provider", "unified_category", "cost", "is_anomaly",
                     "anomaly_type"]
FORECAST_API_COLUMNS = ["date", "cloud_provider", "unified_category", "predicted_cost",
                        "lower_bound", "upper_bound", "model_used"]


def _midnight(d: str | dt.date) -> F.Column:
    return F.lit(str(d)).cast("date").cast("timestamp_ntz")


def stream_filter(df: DataFrame, provider: str, category: str) -> DataFrame:
    """C4: provider/category equality."""
    return df.where((F.col("cloud_provider") == provider) & (F.col("unified_category") == category))


def spend_range(cloud_spend: DataFrame, tenant: str, provider: str, category: str,
                start: str | dt.date, end: str | dt.date) -> DataFrame:
    """Tenant + stream + start <= timestamp <= end, both bounds taken at
    midnight (so rows later on the end day are excluded, D12)."""
    ts = F.col("timestamp")
    return (stream_filter(cloud_spend.where(F.col("organization_id") == tenant), provider, category)
            .where((ts >= _midnight(start)) & (ts <= _midnight(end)))
            .select(*SPEND_API_COLUMNS).orderBy("timestamp"))


def forecast_by_tenant(cloud_forecast: DataFrame, tenant: str) -> DataFrame:
    """All of a tenant's forecast rows by date (empty -> no rows)."""
    return (cloud_forecast.where(F.col("organization_id") == tenant)
            .select(*FORECAST_API_COLUMNS).orderBy("date"))


def first_tenant(organizations: DataFrame) -> DataFrame:
    """The oldest tenant (order by created_at, limit 1)."""
    return organizations.orderBy("created_at", "id").limit(1).select("id", "name")


def stamp_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    """Constant tenant column."""
    return df.withColumn("organization_id", F.lit(tenant_id))


def last_stream_day(cloud_spend: DataFrame, tenant: str, provider: str, category: str):
    """The newest day of a tenant's stream (a single scalar)."""
    row = (stream_filter(cloud_spend.where(F.col("organization_id") == tenant), provider, category)
           .agg(F.max(C.to_day("timestamp")).alias("d")).first())
    return row["d"] if row else None


def history_window(cloud_spend: DataFrame, tenant: str, provider: str, category: str,
                   end: str | dt.date, ranges: Sequence[int] = tuple(fixed.HISTORY_RANGES)) -> DataFrame:
    """For each history range (30/90/180 days): start = end - range,
    and the rows and cost inside [start, end]. One pass, conditional sums."""
    ts = F.col("timestamp")
    base = stream_filter(cloud_spend.where(F.col("organization_id") == tenant), provider, category)
    base = base.where((ts >= _midnight(dt.date.fromisoformat(str(end)) - dt.timedelta(days=max(ranges))))
                      & (ts <= _midnight(end)))
    aggs = []
    for r in ranges:
        inside = ts >= _midnight(dt.date.fromisoformat(str(end)) - dt.timedelta(days=r))
        aggs += [F.count_if(inside).alias(f"n_{r}"),
                 F.coalesce(F.sum(F.when(inside, C.exact("cost"))), F.lit(0)).cast("double").alias(f"c_{r}")]
    g = base.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("history_days"), F.col(f"n_{r}").alias("n_rows"),
                                        F.col(f"c_{r}").alias("cost")) for r in ranges]))
    e = g.select(rows.alias("_r")).select("_r.*")
    end_c = F.lit(str(end)).cast("date")
    return e.select("history_days", F.date_sub(end_c, F.col("history_days")).alias("start_date"),
                    end_c.alias("end_date"), "n_rows", "cost")


def last_per_day(rows: DataFrame, keys: Sequence[str] = (),
                 values: Sequence[str] = ("cost", "is_anomaly", "anomaly_type")) -> DataFrame:
    """Per (keys, day) the row that sorts last on (timestamp, values)
    wins - the dashboard keeps the last row of a day, not the sum (D11)."""
    d = rows.withColumn("date", C.to_day("timestamp"))
    order = ["timestamp", *[v for v in ("cost", "is_anomaly", "anomaly_type") if v in values]]
    return A.last_per_key(d, [*keys, "date"], order, list(values))


def actual_line(actual_rows: DataFrame, agg: str = "last") -> DataFrame:
    """The timeline's actual days: the last row of each day wins, or the day's
    sum (``agg='sum'``)."""
    if agg == "last":
        act = last_per_day(actual_rows)
    else:
        act = (actual_rows.groupBy(C.to_day("timestamp").alias("date"))
               .agg(F.sum(C.exact("cost")).cast("double").alias("cost"), F.max("is_anomaly").alias("is_anomaly"),
                    F.max_by("anomaly_type", "timestamp").alias("anomaly_type")))
    actual = C.round_money("cost")
    return act.select("date", actual.alias("actual"), F.when(F.col("is_anomaly") == 1, actual).alias("anomalyCost"),
                      F.col("is_anomaly").cast("int").alias("isAnomaly"), F.col("anomaly_type").alias("type"))


def timeline(actual_rows: DataFrame, forecast_rows: DataFrame, provider: str, category: str,
             end: str | dt.date, horizon_days: int, agg: str = "last") -> DataFrame:
    """Actuals by day followed by the stream's forecast after the newest
    actual day, up to ``horizon_days`` beyond it; that day's predicted value is
    its actual, so the two lines meet. Without any actual every forecast day up
    to ``end + horizon_days`` is shown. A day is shown once: of several forecasts
    of a day the one of the newest load (``load_number``, where there is one), of
    equal loads the greatest values."""
    act = actual_line(actual_rows, agg)
    # one row whether or not there is an actual
    cut = act.agg(F.max("date").alias("_newest")).withColumn("_k", F.lit(1))
    a = act.withColumn("_k", F.lit(1)).join(F.broadcast(cut), "_k").select(
        "date", "actual", "anomalyCost", F.when(F.col("date") == F.col("_newest"), F.col("actual")).alias("predicted"),
        F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), "isAnomaly", "type")
    fc = stream_filter(forecast_rows, provider, category)
    load = F.col("load_number") if "load_number" in fc.columns else F.lit(0)
    fc = fc.groupBy("date").agg(F.max(F.struct(load.alias("load"), "predicted_cost", "lower_bound", "upper_bound")).alias("f"))
    fc = fc.withColumn("_k", F.lit(1)).join(F.broadcast(cut), "_k").drop("_k")
    last = F.date_add(F.coalesce(F.col("_newest"), F.lit(str(end)).cast("date")), horizon_days)
    fc = fc.where((F.col("_newest").isNull() | (F.col("date") > F.col("_newest"))) & (F.col("date") <= last))
    f = fc.select("date", F.lit(None).cast("double").alias("actual"),
                  F.lit(None).cast("double").alias("anomalyCost"),
                  C.round_money("f.predicted_cost").alias("predicted"),
                  C.round_money("f.lower_bound").alias("lower"), C.round_money("f.upper_bound").alias("upper"),
                  F.lit(0).alias("isAnomaly"), F.lit("none").alias("type"))
    return a.unionByName(f)


def kpi_rollup(tl: DataFrame) -> DataFrame:
    """Current spend (sum of non-zero actuals), projected spend (sum of
    predictions on days without an actual) and the flagged-day count."""
    has_actual = F.col("actual").isNotNull() & (F.col("actual") != 0)
    has_pred = F.col("predicted").isNotNull() & (F.col("predicted") != 0)
    return tl.agg(
        (F.coalesce(F.sum(F.when(has_actual, C.cents("actual"))), F.lit(0)) / 100).alias("current_spend"),
        (F.coalesce(F.sum(F.when(has_pred & ~has_actual, C.cents("predicted"))), F.lit(0)) / 100)
        .alias("projected_spend"),
        F.count_if(F.col("isAnomaly").isNotNull() & (F.col("isAnomaly") != 0)).alias("anomaly_count"))


def incident_queue(tl: DataFrame) -> DataFrame:
    """Flagged timeline days. Forecast days are never flagged, so the
    actual line is enough."""
    return tl.where(F.col("isAnomaly") == 1).select("date", "type", "actual")


def max_date(df: DataFrame, keys: Sequence[str] = S) -> DataFrame:
    """Newest day per stream."""
    return df.groupBy(*keys).agg(F.max(C.to_day("timestamp")).alias("max_date"))
