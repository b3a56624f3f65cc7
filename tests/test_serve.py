"""Dashboard and incident semantics (D11, D12, cut-off, KPI rules, skip note)."""
import datetime as dt

from pyspark.sql import functions as F

from costlens.operators import rca as R
from costlens.operators import serve as SV

SPEND_DDL = ("organization_id string, timestamp timestamp_ntz, cloud_provider string, unified_category string, "
             "cost double, normalized_env string, normalized_team string, is_anomaly int, anomaly_type string")
FC_DDL = ("organization_id string, date date, cloud_provider string, unified_category string, "
          "predicted_cost double, lower_bound double, upper_bound double, model_used string")


def _rows(spark, rows):
    return spark.createDataFrame(rows, SPEND_DDL)


def test_end_day_after_midnight_excluded(spark):
    d = dt.datetime
    cs = _rows(spark, [("o", d(2026, 6, 30, 0, 0), "AWS", "COMPUTE", 1.0, "p", "t", 0, "none"),
                       ("o", d(2026, 6, 30, 10, 0), "AWS", "COMPUTE", 2.0, "p", "t", 0, "none"),
                       ("o", d(2026, 6, 1, 0, 0), "AWS", "COMPUTE", 3.0, "p", "t", 0, "none")])
    got = [r["cost"] for r in SV.spend_range(cs, "o", "AWS", "COMPUTE", "2026-06-01", "2026-06-30").collect()]
    assert got == [3.0, 1.0]


def test_timeline_last_row_cutoff_and_kpis(spark):
    d = dt.datetime
    rows = SV.spend_range(_rows(spark, [
        ("o", d(2026, 6, 29), "AWS", "COMPUTE", 10.0, "p", "t", 0, "none"),
        ("o", d(2026, 6, 29), "AWS", "COMPUTE", 4.0, "p", "t", 1, "spike"),
        ("o", d(2026, 6, 30), "AWS", "COMPUTE", 0.0, "p", "t", 1, "spike")]),
        "o", "AWS", "COMPUTE", "2026-06-01", "2026-06-30")
    fc = spark.createDataFrame([("o", dt.date(2026, 6, 30), "AWS", "COMPUTE", 9.0, 8.0, 10.0, "m"),
                                ("o", dt.date(2026, 7, 1), "AWS", "COMPUTE", 5.0, 4.0, 6.0, "m"),
                                ("o", dt.date(2026, 12, 1), "AWS", "COMPUTE", 5.0, 4.0, 6.0, "m")], FC_DDL)
    tl = SV.timeline(rows, fc, "AWS", "COMPUTE", "2026-06-30", 30)
    by = {r["date"]: r for r in tl.collect()}
    assert set(by) == {dt.date(2026, 6, 29), dt.date(2026, 6, 30), dt.date(2026, 7, 1)}
    assert by[dt.date(2026, 6, 29)]["actual"] == 10.0          # last row by (timestamp, cost)
    assert by[dt.date(2026, 6, 30)]["predicted"] == 0.0        # cut-off row meets the actual
    k = SV.kpi_rollup(tl).first()
    assert k["current_spend"] == 10.0 and k["projected_spend"] == 5.0 and k["anomaly_count"] == 1


def test_rca_skip_note_and_owner(spark):
    d = dt.datetime
    cs = _rows(spark, [("o", d(2026, 3, 8), "AWS", "COMPUTE", 10.0, "prod", "a", 0, "none"),
                       ("o", d(2026, 3, 9), "AWS", "COMPUTE", 10.0, "prod", "a", 0, "none"),
                       ("o", d(2026, 3, 10), "AWS", "COMPUTE", 50.0, "prod", "b", 1, "spike"),
                       ("o", d(2026, 3, 10), "AWS", "COMPUTE", 11.0, "prod", "a", 1, "spike")])
    inc = spark.createDataFrame([("o", "AWS", "COMPUTE", dt.date(2026, 3, 10), "spike"),
                                 ("o", "AWS", "COMPUTE", dt.date(2025, 1, 1), "drift")],
                                "organization_id string, cloud_provider string, unified_category string, "
                                "date date, type string")
    rep = {r["date"]: r for r in R.rca_report(cs, inc).collect()}
    assert "Skipping LLM evaluation" in rep[dt.date(2025, 1, 1)]["report"]
    assert rep[dt.date(2026, 3, 10)]["owner_team"] == "b"
    assert "50.000 USD" in rep[dt.date(2026, 3, 10)]["report"]


def test_timeline_sum_option(spark):
    d = dt.datetime
    rows = SV.spend_range(_rows(spark, [
        ("o", d(2026, 6, 29), "AWS", "COMPUTE", 10.0, "p", "t", 0, "none"),
        ("o", d(2026, 6, 29), "AWS", "COMPUTE", 4.0, "p", "t", 1, "spike")]),
        "o", "AWS", "COMPUTE", "2026-06-01", "2026-06-30")
    fc = spark.createDataFrame([], FC_DDL)
    tl = SV.timeline(rows, fc, "AWS", "COMPUTE", "2026-06-30", 30, agg="sum").collect()
    assert len(tl) == 1 and tl[0]["actual"] == 14.0 and tl[0]["isAnomaly"] == 1


def test_timeline_without_history_shows_the_forecast(spark):
    """No actual row: every forecast day up to the end of the range is shown,
    also days before the end date asked for."""
    fc = spark.createDataFrame([("o", dt.date(2026, 6, d), "AWS", "COMPUTE", 9.0 + d, 8.0, 10.0, "m") for d in (1, 20, 30)]
                               + [("o", dt.date(2026, 9, 1), "AWS", "COMPUTE", 1.0, 1.0, 1.0, "m")], FC_DDL)
    tl = SV.timeline(_rows(spark, []), fc, "AWS", "COMPUTE", "2026-06-15", 30).orderBy("date").collect()
    assert [(r["date"].day, r["predicted"], r["actual"]) for r in tl] == [(1, 10.0, None), (20, 29.0, None), (30, 39.0, None)]
    k = SV.kpi_rollup(SV.timeline(_rows(spark, []), fc, "AWS", "COMPUTE", "2026-06-15", 30)).first()
    assert (k["current_spend"], k["projected_spend"], k["anomaly_count"]) == (0.0, 78.0, 0)


def _stored(spark, loads):
    from costlens import schema as SC
    from costlens.sources import files as IO
    from costlens.sources import versions as V
    path = IO.scratch_path(spark, "t_versions")
    for batch, number, rows in loads:
        df = spark.createDataFrame(rows, FC_DDL).select(*[f.name for f in SC.CLOUD_FORECAST.fields])
        V.write_load(df, path, batch, number)
    return V.read_loads(spark, path, SC.CLOUD_FORECAST)


def test_forecast_loaded_twice_counts_once(spark):
    from costlens.sources import versions as V
    day = dt.date(2026, 7, 1)

    def row(cost, org="o", date=day):
        return (org, date, "AWS", "COMPUTE", cost, cost - 1, cost + 1, "m")
    two = [row(5.0), row(6.0, date=day + dt.timedelta(days=1))]
    loads = _stored(spark, [("run", 1, two), ("run", 1, two), ("run", 2, [row(7.0)]), ("run", 1, [row(9.0, org="p")])])
    got = sorted((r["organization_id"], r["predicted_cost"]) for r in V.newest(loads).collect())
    assert got == [("o", 7.0), ("p", 9.0)]              # load 2 replaced all of load 1 of its tenant
    only = V.newest(loads, F.col("organization_id") == "o", keep_load=True)
    k = SV.kpi_rollup(SV.timeline(_rows(spark, []), only, "AWS", "COMPUTE", day, 30)).first()
    assert k["projected_spend"] == 7.0
    # two batches that both forecast a day: the timeline shows the newest load's
    loads = _stored(spark, [("a", 1, [row(5.0)]), ("b", 2, [row(4.0)])])
    tl = SV.timeline(_rows(spark, []), V.newest(loads, keep_load=True), "AWS", "COMPUTE", day, 30).collect()
    assert [r["predicted"] for r in tl] == [4.0]
    one = V.newest_per_key(loads, ["organization_id", "date", "cloud_provider", "unified_category"]).collect()
    assert [r["predicted_cost"] for r in one] == [4.0]


def test_reads_of_a_stored_table_prune(spark):
    """Tenant and older loads are partitions: the tenant is a partition filter
    of the scan and a missing table is empty."""
    from costlens import schema as SC
    from costlens.sources import versions as V
    loads = _stored(spark, [("run", 1, [("o", dt.date(2026, 7, 1), "AWS", "COMPUTE", 5.0, 4.0, 6.0, "m")])])
    plan = V.newest(loads, F.col("organization_id") == "o")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(organization_id" in plan
    assert V.newest(V.read_loads(spark, "/nonexistent/costlens/forecast", SC.CLOUD_FORECAST)).count() == 0


def test_single_incident_call_equals_the_batch(spark):
    """By day, type and stream text; the same report as the batch gives, and the
    skip note for a day without rows."""
    d = dt.datetime
    cs = _rows(spark, [("o", d(2026, 3, 8, 5), "AWS", "COMPUTE", 10.0, "prod", "a", 0, "none"),
                       ("o", d(2026, 3, 10, 7), "AWS", "COMPUTE", 50.0, "prod", "b", 1, "spike"),
                       ("o", d(2026, 3, 11), "AWS", "COMPUTE", 3.0, "prod", "c", 0, "none"),
                       ("o", d(2026, 3, 11, 1), "AWS", "COMPUTE", 999.0, "prod", "d", 0, "none"),
                       ("p", d(2026, 3, 10), "AWS", "COMPUTE", 700.0, "prod", "x", 0, "none")])
    one = R.rca_single(cs, "o", "2026-03-10", "spike").collect()
    every = R.rca_report(cs).collect()
    assert len(one) == 1 and one == every
    assert one[0]["n_records"] == 3 and one[0]["owner_team"] == "b"
    assert "Skipping" in R.rca_single(cs, "o", "2020-01-01", None, "GCP-STORAGE").first()["report"]


def test_incident_windows_equal_the_rows(spark):
    """Counts and amounts from the day cube are those of the context rows."""
    import random
    rnd = random.Random(6)
    rows = [("o", dt.datetime(2026, 3, 1 + rnd.randrange(12), rnd.choice([0, 0, 9])), rnd.choice(["AWS", None]), "COMPUTE",
             rnd.randrange(1000) / 8, "prod", rnd.choice("abc"), rnd.randint(0, 1), "spike") for _ in range(300)]
    cs = _rows(spark, rows)
    cube = R.day_cube(cs)
    inc = R.cube_incidents(cube)
    assert sorted(map(str, inc.collect())) == sorted(map(str, R.incidents(cs).collect()))
    keys = ["cloud_provider", "date", "normalized_team"]
    want = R.rca_context(cs, inc).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                                      F.sum(F.when(F.to_date("timestamp") == F.col("date"), F.col("cost")).otherwise(0)).alias("e"))
    got = R.incident_windows(cube, inc).groupBy(*keys).agg(F.sum("n_records").alias("n"), F.sum("event").cast("double").alias("e"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 20
