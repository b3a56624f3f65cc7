"""Queries: vendor normalisation and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens import fixed
from costlens.functions import columns as C
from costlens.operators import aggregates as A
from costlens.operators import detect as D
from costlens.operators import normalize as N
from costlens.plans import sqlparts as Q
from costlens.plans.catalog import query
from costlens.sources import tables as T


@query("normalize_aws", Q.with_(("raw_aws", Q.RAW_AWS), final=Q.norm_aws()))
def normalize_aws(spark, sf_dir):
    """B1: AWS export -> canonical spend."""
    return N.normalize_aws(T.raw_aws(T.Tables(spark, sf_dir)))


@query("normalize_gcp", Q.with_(("raw_gcp", Q.RAW_GCP), final=Q.norm_gcp()))
def normalize_gcp(spark, sf_dir):
    """B2: GCP export -> canonical spend."""
    return N.normalize_gcp(T.raw_gcp(T.Tables(spark, sf_dir)))


@query("normalize_azure", Q.with_(("raw_azure", Q.RAW_AZURE), final=Q.norm_azure()))
def normalize_azure(spark, sf_dir):
    """Azure export (JSON tags) -> canonical spend."""
    return N.normalize_azure(T.raw_azure(T.Tables(spark, sf_dir)))


@query("union_clouds", Q.with_(*Q.UNION_CLOUDS, final="SELECT * FROM spend"))
def union_clouds(spark, sf_dir):
    """H1: the three normalised exports as one spend table."""
    t = T.Tables(spark, sf_dir)
    return N.union_clouds(N.normalize_aws(T.raw_aws(t)), N.normalize_gcp(T.raw_gcp(t)),
                          N.normalize_azure(T.raw_azure(t)))


SERVICES = {"AWS": ("raw_aws", "productCode", "lineItem/UnblendedCost", fixed.AWS_SERVICE_MAP),
            "GCP": ("raw_gcp", "service/description", "cost", fixed.GCP_SERVICE_MAP),
            "Azure": ("raw_azure", "MeterCategory", "CostInBillingCurrency", fixed.AZURE_SERVICE_MAP)}


def _raw(t):
    return {"raw_aws": T.raw_aws(t), "raw_gcp": T.raw_gcp(t), "raw_azure": T.raw_azure(t)}


@query("category_map", Q.with_(("raw_aws", Q.RAW_AWS), ("raw_gcp", Q.RAW_GCP), ("raw_azure", Q.RAW_AZURE), final="\nUNION ALL\n".join(
    f"""SELECT '{v}' AS vendor, "{name}" AS service, {Q.category_map(f'"{name}"', m)} AS unified_category, "{cost}" AS cost
FROM {raw}""" for v, (raw, name, cost, m) in SERVICES.items())))
def category_map(spark, sf_dir):
    """Each vendor's service names -> unified category, default OTHER."""
    raws = _raw(T.Tables(spark, sf_dir))
    parts = [raws[raw].select(F.lit(v).alias("vendor"), F.col(f"`{name}`").alias("service"),
                              C.category_map(F.col(f"`{name}`"), m).alias("unified_category"), F.col(f"`{cost}`").alias("cost"))
             for v, (raw, name, cost, m) in SERVICES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("json_tag", f"""SELECT event_id, props, {Q.json_tag('props', 'k')} AS tag_k,
  {Q.json_tag('props', 'env')} AS tag_env, {Q.json_tag('props', 'team')} AS tag_team FROM events""")
def json_tag(spark, sf_dir):
    """Tags from free-form JSON: present key -> value, missing -> unknown."""
    ev = T.Tables(spark, sf_dir).events
    return ev.select("event_id", "props", C.json_tag("props", "k").alias("tag_k"),
                     C.json_tag("props", "env").alias("tag_env"),
                     C.json_tag("props", "team").alias("tag_team"))


TAGS = {"AWS": ("raw_aws", "resourceTags/user:Team", "resourceTags/user:Environment"), "GCP": ("raw_gcp", "labels/owner", "labels/env")}


@query("lower_fill", Q.with_(("raw_aws", Q.RAW_AWS), ("raw_gcp", Q.RAW_GCP), ("raw_azure", Q.RAW_AZURE), final="\nUNION ALL\n".join(
    [f"""SELECT '{v}' AS vendor, "{team}" AS raw_team, {Q.lower_fill(f'"{team}"')} AS normalized_team,
  "{env}" AS raw_env, {Q.lower_fill(f'"{env}"')} AS normalized_env FROM {raw}""" for v, (raw, team, env) in TAGS.items()]
    + [f"""SELECT 'Azure', "MeterCategory", {Q.lower_fill('"MeterCategory"')}, anomaly_type, {Q.lower_fill('anomaly_type')} FROM raw_azure"""])))
def lower_fill(spark, sf_dir):
    """Lower-case tags, missing -> unknown; the vendor whose tags are JSON
    (B5) gives its plain text columns."""
    raws = _raw(T.Tables(spark, sf_dir))
    cols = {**TAGS, "Azure": ("raw_azure", "MeterCategory", "anomaly_type")}
    parts = []
    for v, (raw, team, env) in cols.items():
        team, env = F.col(f"`{team}`"), F.col(f"`{env}`")
        parts.append(raws[raw].select(F.lit(v).alias("vendor"), team.alias("raw_team"), C.lower_fill(team).alias("normalized_team"),
                                      env.alias("raw_env"), C.lower_fill(env).alias("normalized_env")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("parse_ts", Q.with_(("raw", Q.RAW_AZURE_EVENTS), final=f"""SELECT "UsageDateTime" AS raw_ts,
  {Q.parse_ts('"UsageDateTime"')} AS "timestamp",
  CAST({Q.parse_ts('"UsageDateTime"')} AS DATE) AS date FROM raw"""))
def parse_ts(spark, sf_dir):
    """Timestamp text -> timestamp and date."""
    raw = T.raw_azure_events(T.Tables(spark, sf_dir))
    ts = C.parse_ts(F.col("UsageDateTime"))
    return raw.select(F.col("UsageDateTime").alias("raw_ts"), ts.alias("timestamp"),
                      C.to_day(ts).alias("date"))


@query("calendar_features", f"""SELECT event_id, ts, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
  CAST(isodow(ts) - 1 IN (5, 6) AS INTEGER) AS is_weekend FROM events""")
def calendar_features(spark, sf_dir):
    """Monday = 0 weekday and weekend flag."""
    ev = T.Tables(spark, sf_dir).events
    return ev.select("event_id", "ts", C.day_of_week("ts").alias("day_of_week"),
                     C.is_weekend("ts").alias("is_weekend"))


@query("format_cast", """SELECT event_id, CAST(ts AS VARCHAR) AS ts_text,
  CAST(split_part(CAST(ts AS VARCHAR), ' ', 1) AS DATE) AS date FROM events""")
def format_cast(spark, sf_dir):
    """Timestamp -> text, and the date from the text before the blank."""
    ev = T.Tables(spark, sf_dir).events
    txt = C.ts_text("ts")
    return ev.select("event_id", txt.alias("ts_text"), C.date_of_text(txt).alias("date"))


@query("split_stream", Q.with_(*Q.scored_days(), final="""SELECT
  cloud_provider || '-' || unified_category AS stream, date,
  split_part(cloud_provider || '-' || unified_category, '-', 1) AS provider,
  split_part(cloud_provider || '-' || unified_category, '-', 2) AS category FROM scores"""))
def split_stream(spark, sf_dir):
    """B16: 'AWS-COMPUTE' -> provider, category (default AWS-COMPUTE)."""
    days = D.day_scores(T.spend(T.Tables(spark, sf_dir), team=False))
    s = C.stream_name()
    p, c = C.split_stream(s)
    return days.select(s.alias("stream"), "date", p.alias("provider"), c.alias("category"))


@query("math_abs", Q.with_(*Q.scored_days(), final="""SELECT cloud_provider, unified_category, date,
  stat_z_score, ABS(stat_z_score) AS abs_z FROM scores"""))
def math_abs(spark, sf_dir):
    """Absolute value of the day z-score."""
    days = D.day_scores(T.spend(T.Tables(spark, sf_dir), team=False))
    return days.select("cloud_provider", "unified_category", "date", "stat_z_score",
                       F.abs("stat_z_score").alias("abs_z"))


@query("round_money", Q.with_(("spend", Q.spend(team=False)), ("daily", Q.daily()), final="""SELECT
  cloud_provider, unified_category, date, cost, ROUND(cost * 0.85 * 100) / 100 AS low_band,
  ROUND(cost * 1.15 * 100) / 100 AS high_band FROM daily"""))
def round_money(spark, sf_dir):
    """+-15 % bands of each day's cost, rounded to cents."""
    d = A.daily_cost(T.spend(T.Tables(spark, sf_dir), team=False))
    return d.select("cloud_provider", "unified_category", "date", "cost",
                    C.round_money(F.col("cost") * fixed.BAND_LOW).alias("low_band"),
                    C.round_money(F.col("cost") * fixed.BAND_HIGH).alias("high_band"))
