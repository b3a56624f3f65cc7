"""Properties of the statistical tier."""
import datetime as dt
import math
import random

from pyspark.sql import functions as F

from costlens.operators import detect as D


def _spend(spark, days, value):
    start = dt.datetime(2026, 1, 1)
    rows = [(start + dt.timedelta(days=i), "AWS", "COMPUTE", float(value(i)), "prod", "t", 0, "none")
            for i in range(days)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, cloud_provider string, "
                                 "unified_category string, cost double, normalized_env string, "
                                 "normalized_team string, is_anomaly int, anomaly_type string")


def test_z_bound_and_no_early_flag(spark):
    rnd = random.Random(7)
    sp = _spend(spark, 120, lambda i: 1000 + rnd.choice([0, 0, 0, 5000]) + rnd.random() * 10)
    days = D.day_scores(sp).orderBy("date").collect()
    assert max(abs(r["stat_z_score"]) for r in days) <= 13 / math.sqrt(14) + 1e-6
    assert all(r["stat_is_anomaly"] == 0 for r in days[:10])


def test_short_stream_scores_zero(spark):
    days = D.day_scores(_spend(spark, 13, lambda i: 100 + i * i)).collect()
    assert all(r["stat_z_score"] == 0.0 for r in days)


def test_constant_series_scores_zero(spark):
    days = D.day_scores(_spend(spark, 40, lambda i: 250.0)).collect()
    assert all(r["stat_z_score"] == 0.0 for r in days)


def test_vote_rule(spark):
    df = spark.createDataFrame([(1, 0, 0), (0, 1, 1), (0, 1, 0), (0, 0, 1)],
                               "stat_is_anomaly int, ml_is_anomaly int, dl_is_anomaly int")
    assert [r["ensemble_is_anomaly"] for r in D.ensemble_vote(df).collect()] == [1, 1, 0, 0]


def test_contamination_cut_is_strict(spark):
    df = spark.createDataFrame([("AWS", "COMPUTE", float(i)) for i in range(100)],
                               "cloud_provider string, unified_category string, s double")
    flagged = D.contamination_flag(df, "s").where(F.col("ml_is_anomaly") == 1).count()
    assert flagged == 5      # p95 of 0..99 is 94.05: 95..99 are above it


def _rows(spark, rows):
    return spark.createDataFrame(
        [(p, "COMPUTE", t, c, "prod", "core", 0, "none") for p, t, c in rows],
        "cloud_provider string, unified_category string, timestamp timestamp_ntz, cost double, "
        "normalized_env string, normalized_team string, is_anomaly int, anomaly_type string")


def test_sub_cent_costs_add_up(spark):
    import datetime as dt
    from costlens.operators import aggregates, windows
    t = dt.datetime(2024, 1, 1)
    df = _rows(spark, [("AWS", t + dt.timedelta(seconds=i), 0.004) for i in range(1000)])
    for day in (aggregates.daily_cost(df), aggregates.daily_cost_flag(df)):
        r = day.first()
        assert r["cost"] == 4.0 and r["cost_cents"] == 400
    feat = windows.rolling_features(df).orderBy("timestamp").collect()
    assert feat[500]["rolling_mean_7d"] == 0.004 and feat[500]["rolling_std_7d"] == 0.0


def test_null_streams_stay(spark):
    import datetime as dt
    from costlens.operators import scale, windows
    t = dt.datetime(2024, 1, 1)
    df = _rows(spark, [(p, t + dt.timedelta(days=i), 1.0 + i) for p in ("AWS", None) for i in range(5)])
    feat = windows.rolling_features(df)
    assert feat.count() == 10
    out = scale.minmax_scale(feat, ["cost"]).where("cloud_provider is null").orderBy("timestamp").collect()
    assert [r["cost_scaled"] for r in out] == [0.0, 0.25, 0.5, 0.75, 1.0]


def test_null_streams_are_scored_and_forecast(spark):
    """A null key is a stream to the day scores and the forecasts too."""
    import datetime as dt
    from costlens.operators import forecast_window as FW
    t = dt.datetime(2024, 1, 1)
    df = _rows(spark, [(p, t + dt.timedelta(days=i), 10.0 + (i % 5) + (400 if i == 50 else 0)) for p in ("AWS", None) for i in range(70)])
    scored = D.stat_detector(df)
    flagged = {(r["cloud_provider"], r["timestamp"].date()) for r in scored.where("stat_is_anomaly = 1").collect()}
    assert (None, dt.date(2024, 2, 20)) in flagged and ("AWS", dt.date(2024, 2, 20)) in flagged
    fc = FW.production_forecast_exact(FW.cleaned_series(df)).groupBy("cloud_provider").count().collect()
    assert {r["cloud_provider"]: r["count"] for r in fc} == {"AWS": 90, None: 90}
