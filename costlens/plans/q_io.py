"""Queries: sources, sinks and the streaming append.

Each query writes what it needs under the session's checkpoint folder
(a fresh sub-folder per call) and returns the read-back, so the check
compares what actually landed in storage.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from costlens import schema as SC
from costlens.operators import detect as D
from costlens.operators import forecast_window as FW
from costlens.operators import normalize as N
from costlens.operators import serve as SV
from costlens.plans import ingest as IG
from costlens.plans import sqlparts as Q
from costlens.plans.catalog import query
from costlens.plans.q_serve import ORGS
from costlens.sources import exports as EX
from costlens.sources import files as IO
from costlens.sources import tables as T
from costlens.sources import versions as V
from costlens.streaming import append as K
from costlens.streaming import dedupe as KD

FIRST = "(SELECT id FROM orgs ORDER BY created_at, id LIMIT 1)"


def _first_tenant(t):
    return SV.first_tenant(T.organizations(t)).first()["id"]


# the columns of each vendor's export, under common names
LAYOUT = {"aws": ("lineItem/UsageStartDate", "productCode", "lineItem/UnblendedCost"),
          "gcp": ("usage_start_time", "service/description", "cost"),
          "azure": ("UsageDateTime", "MeterCategory", "CostInBillingCurrency")}


@query("scan_billing_csv", Q.with_(("raw_aws", Q.RAW_AWS), ("raw_gcp", Q.RAW_GCP), ("raw_azure", Q.RAW_AZURE), final="\nUNION ALL\n".join(
    f"""SELECT '{v}' AS vendor, "{when}" AS usage_time, "{name}" AS service, "{cost}" AS cost, is_anomaly, anomaly_type FROM raw_{v}"""
    for v, (when, name, cost) in LAYOUT.items())))
def scan_billing_csv(spark, sf_dir):
    """A1: the three vendors' exports written as headered CSV, read back with
    their schemas and the CSV null-token rule."""
    _, paths = _written_exports(spark, sf_dir)
    parts = [IO.read_billing_csv(spark, paths[v], EX.VENDORS[v][0]).select(
        F.lit(v).alias("vendor"), F.col(f"`{when}`").alias("usage_time"), F.col(f"`{name}`").alias("service"),
        F.col(f"`{cost}`").alias("cost"), "is_anomaly", "anomaly_type") for v, (when, name, cost) in LAYOUT.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("scan_table", Q.with_(("cs", Q.spend(team=True, tenant=True)), final="""SELECT "timestamp",
  cloud_provider, unified_category, cost, is_anomaly, anomaly_type FROM cs
WHERE organization_id = 'org-1' AND cloud_provider = 'AWS' AND unified_category = 'COMPUTE'
  AND "timestamp" >= TIMESTAMP '1998-01-01 00:00:00' AND "timestamp" <= TIMESTAMP '1998-12-31 00:00:00'"""))
def scan_table(spark, sf_dir):
    """A4: the tenant table (Parquet, partitioned by tenant) read with a
    tenant + stream + time predicate: partition pruning plus pushed filters."""
    path = IO.scratch_path(spark, "cloud_spend")
    IO.write_tenant_table(T.spend(T.Tables(spark, sf_dir), team=True, tenant=True), path)
    return SV.spend_range(IO.read_tenant_table(spark, path), "org-1", "AWS", "COMPUTE",
                          dt.date(1998, 1, 1), dt.date(1998, 12, 31))


@query("write_dataset", Q.with_(*Q.scored_days(), final="SELECT * FROM scores"))
def write_dataset(spark, sf_dir):
    """A5: scored stream-days written as Parquet (overwrite) and read back."""
    days = D.day_scores(T.spend(T.Tables(spark, sf_dir), team=False))
    return IO.write_dataset(days, IO.scratch_path(spark, "scored_days"))


@query("append_spend", Q.with_(("orgs", ORGS), ("spend", Q.spend(team=True)),
                               final=f"SELECT s.*, o.id AS organization_id FROM spend s, {FIRST} o"))
def append_spend(spark, sf_dir):
    """Spend stamped with the oldest tenant and appended to the tenant
    table; the read-back is returned."""
    t = T.Tables(spark, sf_dir)
    path = IO.scratch_path(spark, "cloud_spend")
    IO.write_tenant_table(SV.stamp_tenant(T.spend(t, team=True), _first_tenant(t)), path)
    return IO.read_tenant_table(spark, path)


@query("append_forecast", Q.with_(("orgs", ORGS), *Q.series_ctes(), *Q.production(),
                                  final=f"SELECT p.*, o.id AS organization_id FROM production p, {FIRST} o"))
def append_forecast(spark, sf_dir):
    """The routed forecast stamped with the oldest tenant, appended to
    the forecast table and read back."""
    t = T.Tables(spark, sf_dir)
    fc = FW.production_forecast_exact(FW.cleaned_series(T.spend(t, team=False)))
    fc = SV.stamp_tenant(fc.withColumn("date", F.to_date("date")), _first_tenant(t))
    path = IO.scratch_path(spark, "cloud_forecast")
    IO.write_tenant_table(fc, path)
    return IO.read_tenant_table(spark, path)


EVENTS_NORM = Q.norm_azure("raw_ev")


@query("append_event", Q.with_(("orgs", ORGS), ("spend", Q.spend(team=True)), ("raw_ev", Q.RAW_AZURE_EVENTS),
                               final=f"""SELECT s.*, o.id AS organization_id FROM spend s, {FIRST} o
UNION ALL SELECT e.*, o.id FROM ({EVENTS_NORM}) e, {FIRST} o"""))
def append_event(spark, sf_dir):
    """Arriving billing rows (the event feed as an Azure export) are
    normalised and appended to a tenant table that already holds spend."""
    t = T.Tables(spark, sf_dir)
    tenant = _first_tenant(t)
    path = IO.scratch_path(spark, "cloud_spend")
    IO.write_tenant_table(SV.stamp_tenant(T.spend(t, team=True), tenant), path)
    arriving = N.normalize_azure(T.raw_azure_events(t))
    IO.write_tenant_table(SV.stamp_tenant(arriving, tenant), path)
    return IO.read_tenant_table(spark, path)


@query("stream_append", Q.with_(("orgs", ORGS), ("raw_ev", Q.RAW_AZURE_EVENTS),
                                final=f"SELECT e.*, o.id AS organization_id FROM ({EVENTS_NORM}) e, {FIRST} o"))
def stream_append(spark, sf_dir):
    """K1: the event table re-written as several Parquet files, consumed by
    a Structured Streaming file source, normalised and appended per
    micro-batch to the tenant table (checkpointed); read back."""
    t = T.Tables(spark, sf_dir)
    ev = t.events
    src = IO.scratch_path(spark, "arriving")
    ev.repartition(4, "event_id").write.parquet(src)
    sink, ckpt = IO.scratch_path(spark, "cloud_spend"), IO.scratch_path(spark, "stream_ckpt")
    K.stream_append(spark, src, ev.schema, _first_tenant(t), sink, ckpt)
    return IO.read_tenant_table(spark, sink)


def _written_exports(spark, sf_dir, raw=lambda vendor, df: df):
    """The three vendors' exports as CSV folders."""
    t = T.Tables(spark, sf_dir)
    paths = {}
    for vendor, frame in (("aws", T.raw_aws(t)), ("gcp", T.raw_gcp(t)), ("azure", T.raw_azure(t))):
        paths[vendor] = IO.scratch_path(spark, f"{vendor}_raw_billing.csv")
        IO.write_billing_csv(raw(vendor, frame), paths[vendor])
    return t, paths


@query("ingest_exports", Q.with_(("orgs", ORGS), ("raw_aws", Q.RAW_AWS), ("raw_gcp", Q.RAW_GCP), ("raw_azure", Q.RAW_AZURE),
                                 final=f"""SELECT u.*, o.id AS organization_id FROM (
SELECT * FROM ({Q.norm_aws()}) UNION ALL SELECT * FROM ({Q.norm_gcp()}) UNION ALL SELECT * FROM ({Q.norm_azure()})) u, {FIRST} o"""))
def ingest_exports(spark, sf_dir):
    """The loader job from the three vendors' CSV exports to
    the tenant table, loaded twice with one number, read back."""
    t, paths = _written_exports(spark, sf_dir)
    out = IO.scratch_path(spark, "ingest")
    for _ in range(2):
        report = IG.run_ingest(spark, paths, T.organizations(t), out, forecast=f"{out}/no_forecast.csv")
    return V.newest(V.read_loads(spark, report.spend_path, SC.CLOUD_SPEND)).select(*SC.SPEND_COLUMNS, "organization_id")


_LARGE = 1000


@query("quarantine_exports", Q.with_(("raw_aws", Q.RAW_AWS), ("raw_gcp", Q.RAW_GCP), ("raw_azure", Q.RAW_AZURE), ("c", """
SELECT 'aws' AS vendor, "lineItem/UnblendedCost" AS cost FROM raw_aws UNION ALL SELECT 'gcp', cost FROM raw_gcp
UNION ALL SELECT 'azure', "CostInBillingCurrency" FROM raw_azure"""), final=f"""SELECT vendor,
  COUNT(*) FILTER (WHERE ROUND(cost, 2) < {_LARGE}) AS n_rows, COUNT(*) FILTER (WHERE ROUND(cost, 2) >= {_LARGE}) AS n_rejected
FROM c GROUP BY vendor"""))
def quarantine_exports(spark, sf_dir):
    """A1: exports whose costs of a thousand and more are written as '1,234.50':
    those records are quarantined, none is lost, none becomes a null cost."""
    names = {"aws": "lineItem/UnblendedCost", "gcp": "cost", "azure": "CostInBillingCurrency"}
    t, paths = _written_exports(spark, sf_dir, lambda vendor, df: df.withColumn(
        names[vendor], F.format_number(F.col(f"`{names[vendor]}`"), 2)))
    rows, rejected = EX.normalized_exports(spark, paths)
    good = rows.groupBy(F.lower("cloud_provider").alias("vendor")).agg(F.count("cost").alias("n_rows"))
    bad = rejected.groupBy("vendor").agg(F.count(F.lit(1)).alias("n_rejected"))
    return good.join(bad, "vendor", "full").na.fill(0, ["n_rows", "n_rejected"])


@query("stream_dedupe", Q.with_(("orgs", ORGS), ("raw_ev", Q.RAW_AZURE_EVENTS.replace("SELECT", "SELECT event_id,", 1)),
                                final=f"""SELECT e.*, o.id AS organization_id FROM ({Q.norm_azure("raw_ev").replace("SELECT", "SELECT event_id,", 1)}) e, {FIRST} o"""))
def stream_dedupe(spark, sf_dir):
    """K1: the event feed delivered as files of which a third come twice, one of
    them to a stream whose checkpoint was lost: every event is stored once."""
    t = T.Tables(spark, sf_dir)
    ev = t.events
    src, again = IO.scratch_path(spark, "arriving"), IO.scratch_path(spark, "arriving_again")
    dealt = F.pmod(F.xxhash64("event_id"), F.lit(3))
    ev.repartition(3, dealt).write.parquet(src)
    ev.where(dealt == 0).repartition(1).write.mode("append").parquet(src)
    ev.where(dealt == 1).write.parquet(again)
    path, ckpt = IO.scratch_path(spark, "cloud_events"), IO.scratch_path(spark, "stream_ckpt")

    def normalise(rows):
        return N.normalize_azure(T.events_as_azure(rows, "event_id"), "event_id")
    KD.stream_events(spark, src, ev.schema, normalise, _first_tenant(t), path, f"{ckpt}/a", "feed")
    KD.stream_events(spark, again, ev.schema, normalise, _first_tenant(t), path, f"{ckpt}/b", "feed-2")
    return KD.read_events(spark, path)
