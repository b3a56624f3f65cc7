"""Queries: the dashboard read path for one tenant's stream and the
tenant-scoped tables (C1, C2, C4, C5, C7, C10, D4, E10-E12, B12).

Dashboard parameters: tenant org-1, stream AWS/COMPUTE, 180 days of
history and 90 days of forecast, ending on the stream's newest day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from costlens.operators import forecast_window as FW
from costlens.operators import serve as SV
from costlens import schema as SC
from costlens.plans import sqlparts as Q
from costlens.plans.catalog import query
from costlens.sources import files as IO
from costlens.sources import tables as T
from costlens.sources import versions as V

TENANT, PROVIDER, CATEGORY, HISTORY, HORIZON = "org-1", "AWS", "COMPUTE", 180, 90
TK = "organization_id, cloud_provider, unified_category"

CS = [("cs", Q.spend(team=True, tenant=True)),
      ("params", f"""SELECT MAX(CAST("timestamp" AS DATE)) AS end_date FROM cs
WHERE organization_id = '{TENANT}' AND cloud_provider = '{PROVIDER}' AND unified_category = '{CATEGORY}'"""),
      ("rng", f"""SELECT "timestamp", cloud_provider, unified_category, cost, is_anomaly, anomaly_type
FROM cs, params WHERE organization_id = '{TENANT}' AND cloud_provider = '{PROVIDER}'
  AND unified_category = '{CATEGORY}' AND "timestamp" >= CAST(end_date - {HISTORY} AS TIMESTAMP)
  AND "timestamp" <= CAST(end_date AS TIMESTAMP)""")]

FC = [("spend", "SELECT * FROM cs"), ("d", Q.daily_flag(keys=TK)), ("series", Q.cleaned(keys=TK)),
      *[(n, s) for n, s in Q.production(keys=TK)],
      ("fc", "SELECT * FROM production")]

ORGS = """SELECT 'org-' || CAST(r_regionkey AS VARCHAR) AS id, r_name AS name, 'ENTERPRISE' AS tier,
  TIMESTAMP '2026-01-01 00:00:00' + r_regionkey * INTERVAL 1 DAY AS created_at FROM region"""

TIMELINE = [("act0", """SELECT CAST("timestamp" AS DATE) AS date, cost, is_anomaly, anomaly_type,
  ROW_NUMBER() OVER (PARTITION BY CAST("timestamp" AS DATE)
                     ORDER BY "timestamp" DESC, cost DESC, is_anomaly DESC, anomaly_type DESC) AS _rn FROM rng"""),
            ("act", "SELECT * EXCLUDE (_rn) FROM act0 WHERE _rn = 1"),
            ("cut", "SELECT COALESCE(MAX(date), (SELECT end_date FROM params)) AS _cutoff FROM act"),
            ("tl", f"""SELECT date, ROUND(cost * 100) / 100 AS actual,
  CASE WHEN is_anomaly = 1 THEN ROUND(cost * 100) / 100 END AS "anomalyCost",
  CASE WHEN date = _cutoff THEN ROUND(cost * 100) / 100 END AS predicted,
  CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper,
  CAST(is_anomaly AS INTEGER) AS "isAnomaly", anomaly_type AS type FROM act, cut
UNION ALL
SELECT date, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), ROUND(predicted_cost * 100) / 100,
  ROUND(lower_bound * 100) / 100, ROUND(upper_bound * 100) / 100, 0, 'none'
FROM fc, cut WHERE organization_id = '{TENANT}' AND cloud_provider = '{PROVIDER}'
  AND unified_category = '{CATEGORY}' AND date > _cutoff AND date <= CAST(_cutoff + {HORIZON} AS DATE)""")]


def cloud_spend(spark, sf_dir):
    return T.spend(T.Tables(spark, sf_dir), team=True, tenant=True)


KEYS = ["organization_id", "cloud_provider", "unified_category"]


def stored_forecast(spark, cs):
    """The routed forecast of the tenants and streams in ``cs``, loaded into the
    versioned forecast table; all its loads."""
    fc = FW.production_forecast_exact(FW.cleaned_series(cs, KEYS), keys=KEYS)
    fc = fc.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SC.CLOUD_FORECAST.fields])
    path = IO.scratch_path(spark, "cloud_forecast")
    V.write_load(fc, path, "routed", 1)
    return V.read_loads(spark, path, SC.CLOUD_FORECAST)


def _dash(spark, sf_dir):
    cs = cloud_spend(spark, sf_dir)
    end = SV.last_stream_day(cs, TENANT, PROVIDER, CATEGORY) or dt.date(1970, 1, 1)
    return cs, end, end - dt.timedelta(days=HISTORY)


def _actual_rows(spark, sf_dir):
    cs, end, start = _dash(spark, sf_dir)
    return cs, SV.spend_range(cs, TENANT, PROVIDER, CATEGORY, start, end), end


def _timeline(spark, sf_dir):
    cs, rows, end = _actual_rows(spark, sf_dir)
    # only the stream that is shown gets a forecast
    own = SV.stream_filter(cs.where(F.col("organization_id") == TENANT), PROVIDER, CATEGORY)
    fc = V.newest(stored_forecast(spark, own), F.col("organization_id") == TENANT, keep_load=True)
    return SV.timeline(rows, fc, PROVIDER, CATEGORY, end, HORIZON)


@query("spend_range", Q.with_(*CS, final="SELECT * FROM rng"))
def spend_range(spark, sf_dir):
    """One tenant's stream between two dates (midnight bounds)."""
    cs, end, start = _dash(spark, sf_dir)
    return SV.spend_range(cs, TENANT, PROVIDER, CATEGORY, start, end)


@query("forecast_by_tenant", Q.with_(*CS, *FC, final=f"""SELECT date, cloud_provider, unified_category,
  predicted_cost, lower_bound, upper_bound, model_used FROM fc WHERE organization_id = '{TENANT}'"""))
def forecast_by_tenant(spark, sf_dir):
    """All forecast rows of one tenant (per-tenant routed forecasts)."""
    own = cloud_spend(spark, sf_dir).where(F.col("organization_id") == TENANT)
    return SV.forecast_by_tenant(V.newest(stored_forecast(spark, own), F.col("organization_id") == TENANT), TENANT)


@query("stream_filter", Q.with_(("spend", Q.spend(team=True)), final=f"""SELECT * FROM spend
WHERE cloud_provider = '{PROVIDER}' AND unified_category = '{CATEGORY}'"""))
def stream_filter(spark, sf_dir):
    """C4: provider/category equality filter."""
    return SV.stream_filter(T.spend(T.Tables(spark, sf_dir), team=True), PROVIDER, CATEGORY)


@query("first_tenant", Q.with_(("orgs", ORGS), final="SELECT id, name FROM orgs ORDER BY created_at, id LIMIT 1"))
def first_tenant(spark, sf_dir):
    """The oldest tenant."""
    return SV.first_tenant(T.organizations(T.Tables(spark, sf_dir)))


@query("stamp_tenant", Q.with_(("orgs", ORGS), ("spend", Q.spend(team=True)), final="""SELECT s.*, o.id AS organization_id
FROM spend s, (SELECT id FROM orgs ORDER BY created_at, id LIMIT 1) o"""))
def stamp_tenant(spark, sf_dir):
    """Every spend row stamped with the oldest tenant's id (loader rule)."""
    t = T.Tables(spark, sf_dir)
    tenant = SV.first_tenant(T.organizations(t)).first()["id"]
    return SV.stamp_tenant(T.spend(t, team=True), tenant)


@query("history_window", Q.with_(*CS, final=f"""SELECT h AS history_days, CAST(end_date - h AS DATE) AS start_date,
  end_date, COUNT(c."timestamp") AS n_rows, COALESCE({Q.sum_money('c.cost')}, 0) AS cost
FROM params, (SELECT CAST(unnest([30, 90, 180]) AS INTEGER) AS h) hs
LEFT JOIN cs c ON c.organization_id = '{TENANT}' AND c.cloud_provider = '{PROVIDER}'
  AND c.unified_category = '{CATEGORY}' AND c."timestamp" >= CAST(end_date - h AS TIMESTAMP)
  AND c."timestamp" <= CAST(end_date AS TIMESTAMP)
GROUP BY h, end_date"""))
def history_window(spark, sf_dir):
    """30/90/180-day windows ending on the stream's newest day."""
    cs, end, _ = _dash(spark, sf_dir)
    return SV.history_window(cs, TENANT, PROVIDER, CATEGORY, end)


@query("timeline_merge", Q.with_(*CS, *FC, *TIMELINE, final="SELECT * FROM tl"))
def timeline_merge(spark, sf_dir):
    """Actual (last row per day) and forecast lines for the dashboard."""
    return _timeline(spark, sf_dir)


@query("kpi_rollup", Q.with_(*CS, *FC, *TIMELINE, final="""SELECT
  COALESCE(CAST(SUM(CASE WHEN actual IS NOT NULL AND actual <> 0 THEN CAST(ROUND(actual * 100) AS BIGINT) END) AS BIGINT), 0) / 100.0 AS current_spend,
  COALESCE(CAST(SUM(CASE WHEN predicted IS NOT NULL AND predicted <> 0 AND NOT (actual IS NOT NULL AND actual <> 0)
                         THEN CAST(ROUND(predicted * 100) AS BIGINT) END) AS BIGINT), 0) / 100.0 AS projected_spend,
  COUNT(*) FILTER (WHERE "isAnomaly" IS NOT NULL AND "isAnomaly" <> 0) AS anomaly_count FROM tl"""))
def kpi_rollup(spark, sf_dir):
    """Current spend, projected spend and anomaly count of the timeline."""
    return SV.kpi_rollup(_timeline(spark, sf_dir))


@query("incident_queue", Q.with_(*CS, *FC, *TIMELINE, final="""SELECT date, type, actual FROM tl
WHERE "isAnomaly" = 1"""))
def incident_queue(spark, sf_dir):
    """Flagged days of the timeline."""
    _, rows, _ = _actual_rows(spark, sf_dir)
    return SV.incident_queue(SV.actual_line(rows))


@query("last_per_day", Q.with_(("spend", Q.spend(team=False)), final=f"""SELECT {Q.S}, date, cost, is_anomaly, anomaly_type
FROM (SELECT {Q.S}, CAST("timestamp" AS DATE) AS date, cost, is_anomaly, anomaly_type,
        ROW_NUMBER() OVER (PARTITION BY {Q.S}, CAST("timestamp" AS DATE)
                           ORDER BY "timestamp" DESC, cost DESC, is_anomaly DESC, anomaly_type DESC) AS _rn
      FROM spend) WHERE _rn = 1"""))
def last_per_day(spark, sf_dir):
    """The last row of each stream-day wins (max over an ordered struct)."""
    return SV.last_per_day(T.spend(T.Tables(spark, sf_dir), team=False),
                           keys=["cloud_provider", "unified_category"])


@query("max_date", Q.with_(("spend", Q.spend(team=False)), final=f"""SELECT {Q.S},
  MAX(CAST("timestamp" AS DATE)) AS max_date FROM spend GROUP BY ALL"""))
def max_date(spark, sf_dir):
    """Each stream's newest day (history cut-off)."""
    return SV.max_date(T.spend(T.Tables(spark, sf_dir), team=False))


EV = """SELECT 'org-events' AS organization_id, ts AS "timestamp", 'Azure' AS cloud_provider,
  UPPER(event_type) AS unified_category, value AS cost, 0 AS is_anomaly, 'none' AS anomaly_type FROM events"""


@query("spend_range_intraday", Q.with_(("ev", EV), ("params", """SELECT MAX(CAST("timestamp" AS DATE)) AS end_date
FROM ev WHERE organization_id = 'org-events' AND cloud_provider = 'Azure' AND unified_category = 'CLICK'"""),
    final="""SELECT "timestamp", cloud_provider, unified_category, cost, is_anomaly, anomaly_type FROM ev, params
WHERE organization_id = 'org-events' AND cloud_provider = 'Azure' AND unified_category = 'CLICK'
  AND "timestamp" >= CAST(end_date - 7 AS TIMESTAMP) AND "timestamp" <= CAST(end_date AS TIMESTAMP)"""))
def spend_range_intraday(spark, sf_dir):
    """C1 on the intraday event feed: the last 7 days of one stream, both
    bounds at midnight, so events later on the end day are excluded (D12)."""
    ev = T.event_spend(T.Tables(spark, sf_dir))
    end = SV.last_stream_day(ev, "org-events", "Azure", "CLICK")
    start = end - dt.timedelta(days=7) if end else None
    return SV.spend_range(ev, "org-events", "Azure", "CLICK", start, end)
