"""Queries: incident context, owner attribution and reports for every
incident of every tenant and stream (C3, J2, J3, J4, B18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens import fixed
from costlens.operators import rca as R
from costlens.operators import serve as SV
from costlens.plans import sqlparts as Q
from costlens.plans.catalog import query
from costlens.session import materialize
from costlens.sources import tables as T

K = "organization_id, cloud_provider, unified_category"
ON = " AND ".join(f"c.{k} = i.{k}" for k in K.split(", "))

INC = [("cs", Q.spend(team=True, tenant=True)),
       ("lp", f"""SELECT {K}, date, is_anomaly, anomaly_type FROM (
  SELECT {K}, CAST("timestamp" AS DATE) AS date, is_anomaly, anomaly_type,
    ROW_NUMBER() OVER (PARTITION BY {K}, CAST("timestamp" AS DATE)
                       ORDER BY "timestamp" DESC, cost DESC, is_anomaly DESC, anomaly_type DESC) AS _rn
  FROM cs) WHERE _rn = 1"""),
       ("inc", f"SELECT {K}, date, anomaly_type AS type FROM lp WHERE is_anomaly = 1"),
       ("ctx", f"""SELECT i.*, c."timestamp", CAST(c."timestamp" AS VARCHAR) AS ts_text, c.cost,
  c.normalized_team, c.normalized_env
FROM inc i JOIN cs c ON {ON} AND c."timestamp" >= CAST(i.date - 2 AS TIMESTAMP)
  AND c."timestamp" <= CAST(i.date + 1 AS TIMESTAMP)"""),
       ("jumps", f"""SELECT *, 2 * event_cents - before_cents AS jump_half_cents,
  CAST(2 * event_cents - before_cents AS DOUBLE) / 200 AS jump,
  CAST(ABS(2 * event_cents - before_cents) AS DOUBLE) / 200 AS abs_jump
FROM (SELECT {K}, date, type, normalized_team, normalized_env,
        {Q.sum_cents('CASE WHEN CAST("timestamp" AS DATE) = date THEN cost ELSE 0 END')} AS event_cents,
        {Q.sum_cents('CASE WHEN CAST("timestamp" AS DATE) < date THEN cost ELSE 0 END')} AS before_cents
      FROM ctx GROUP BY ALL)"""),
       ("top", f"""SELECT * EXCLUDE (_rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {K}, date
  ORDER BY jump_half_cents DESC, normalized_team, normalized_env) AS _rn FROM jumps) WHERE _rn = 1""")]


def _report_sql(note: str) -> str:
    acts = " || chr(10) || ".join(f"'{a}'" for a in fixed.REPORT_ACTIONS)
    return (f"'{fixed.REPORT_HEADER}' || chr(10) || 'Target Event Date: ' || CAST(date AS VARCHAR) || chr(10)"
            f" || 'Identified Topology: ' || COALESCE(type, '{fixed.REPORT_DEFAULT_TYPE}') || chr(10)"
            f" || 'Platform Stream: ' || COALESCE(cloud_provider || '-' || unified_category,"
            f" '{fixed.REPORT_DEFAULT_STREAM}') || chr(10) || chr(10)"
            f" || 'Executive Summary of Investigation:' || chr(10) || COALESCE({note}, '{fixed.REPORT_NO_NOTES}')"
            f" || chr(10) || chr(10) || 'Action Item Matrix:' || chr(10) || {acts} || chr(10)"
            f" || '{fixed.REPORT_FOOTER}'")


MONEY = ("CASE WHEN t.jump_half_cents < 0 THEN '-' ELSE '' END || CAST((ABS(t.jump_half_cents) * 5) // 1000 AS VARCHAR)"
         " || '.' || lpad(CAST((ABS(t.jump_half_cents) * 5) % 1000 AS VARCHAR), 3, '0')")
SUMMARY = (f"CASE WHEN COALESCE(n.n_records, 0) = 0 THEN '{fixed.REPORT_SKIP_NOTE}' ELSE "
           "'Triage Analysis Complete:' || chr(10) || 'Largest jump: team ' || t.normalized_team || ', env '"
           f" || t.normalized_env || ', ' || {MONEY} || ' USD on the event day against the mean of the two prior days ('"
           " || CAST(COALESCE(n.n_records, 0) AS VARCHAR) || ' records).' END")


def _ctx(spark, sf_dir):
    cs = T.spend(T.Tables(spark, sf_dir), team=True, tenant=True)
    return cs, R.incidents(cs)


def _windows(spark, sf_dir):
    """Each incident's window by owner, from the day cube; one pass over the rows."""
    cube = materialize(R.day_cube(T.spend(T.Tables(spark, sf_dir), team=True, tenant=True)), "incident-cube")
    return R.incident_windows(cube, R.cube_incidents(cube))


@query("rca_context", Q.with_(*INC, final="SELECT * FROM ctx"))
def rca_context(spark, sf_dir):
    """Spend rows around every incident (d-2 .. d+1, midnight bounds)."""
    cs, inc = _ctx(spark, sf_dir)
    return R.rca_context(cs, inc)


@query("owner_jump", Q.with_(*INC, final="SELECT * FROM jumps"))
def owner_jump(spark, sf_dir):
    """Per incident and (team, env), event-day cost vs the prior-day mean."""
    return R.owner_jump(_windows(spark, sf_dir))


@query("owner_attribution", Q.with_(*INC, final="SELECT * FROM top"))
def owner_attribution(spark, sf_dir):
    """The owner with the largest jump per incident."""
    return R.owner_attribution(R.owner_jump(_windows(spark, sf_dir)))


@query("rca_report", Q.with_(*INC, ("n", f"SELECT {K}, date, COUNT(*) AS n_records FROM ctx GROUP BY ALL"),
                             final=f"""SELECT i.organization_id, i.cloud_provider, i.unified_category, i.date, i.type,
  COALESCE(n.n_records, 0) AS n_records, t.normalized_team AS owner_team, t.normalized_env AS owner_env,
  {_report_sql(SUMMARY).replace('date AS', 'i.date AS').replace('COALESCE(type', 'COALESCE(i.type').replace('COALESCE(cloud_provider || \'-\' || unified_category', 'COALESCE(i.cloud_provider || \'-\' || i.unified_category')} AS report
FROM inc i LEFT JOIN n USING ({K}, date) LEFT JOIN top t USING ({K}, date)"""))
def rca_report(spark, sf_dir):
    """A root-cause report for every incident (skip note when empty)."""
    return R.rca_report(T.spend(T.Tables(spark, sf_dir), team=True, tenant=True))


@query("report_text", Q.with_(*INC, ("n", f"SELECT {K}, date, COUNT(*) AS n_records FROM ctx GROUP BY ALL"),
                              final=f"""SELECT {K}, date, {_report_sql(
    "'Successfully fetched ' || CAST(n_records AS VARCHAR) || ' scoped records for ' || cloud_provider || ' ' || unified_category || '.'")} AS report
FROM (SELECT *, CAST(NULL AS VARCHAR) AS type FROM n)"""))
def report_text(spark, sf_dir):
    """The report template filled with the data-fetch note."""
    n = _windows(spark, sf_dir).groupBy(*R.TENANT_STREAM, "date").agg(F.sum("n_records").alias("n"))
    note = R.fetch_note(F.col("n"), F.col("cloud_provider"), F.col("unified_category"))
    return n.select(*R.TENANT_STREAM, "date",
                    R.report_text(F.col("date"), F.lit(None).cast("string"),
                                  F.concat_ws("-", "cloud_provider", "unified_category"), note).alias("report"))


LATEST = ("one", f"""SELECT * FROM inc WHERE organization_id = 'org-1' AND cloud_provider = 'AWS'
  AND unified_category = 'COMPUTE' ORDER BY date DESC LIMIT 1""")


@query("rca_single", Q.with_(*INC, LATEST, ("n", f"SELECT {K}, date, COUNT(*) AS n_records FROM ctx GROUP BY ALL"),
                             final=f"""SELECT i.organization_id, i.cloud_provider, i.unified_category, i.date, i.type,
  COALESCE(n.n_records, 0) AS n_records, t.normalized_team AS owner_team, t.normalized_env AS owner_env,
  {_report_sql(SUMMARY).replace('date AS', 'i.date AS').replace('COALESCE(type', 'COALESCE(i.type').replace('COALESCE(cloud_provider || \'-\' || unified_category', 'COALESCE(i.cloud_provider || \'-\' || i.unified_category')} AS report
FROM one i LEFT JOIN n USING ({K}, date) LEFT JOIN top t USING ({K}, date)"""))
def rca_single(spark, sf_dir):
    """J4 as one call: the newest incident of a tenant's stream, named by day,
    type and stream text, as the dashboard hands it over."""
    cs = T.spend(T.Tables(spark, sf_dir), team=True, tenant=True)
    own = SV.stream_filter(cs.where("organization_id = 'org-1'"), "AWS", "COMPUTE")
    newest = R.incidents(own).agg(F.max(F.struct("date", "type")).alias("x")).first()["x"]
    if newest is None:
        return R.rca_single(cs, "org-1", "1970-01-01").limit(0)
    return R.rca_single(cs, "org-1", newest["date"], newest["type"], "AWS-COMPUTE")
