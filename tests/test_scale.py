"""Joins with small tables stay broadcasts whatever the rows' number, row
features by ordered batches, and the walk of the trees."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from costlens.operators import iforest as IF
from costlens.operators import scale as SC
from costlens.operators import windows as W
from costlens.sources import versions as V
from costlens.streaming import dedupe as KD


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_guess(spark):
    """Only tables of a few KB are broadcast by their size."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rows_are_not_dealt_by_load(spark, no_guess):
    one = F.col("id") % 1
    loads = spark.range(200_000).select(one.cast("string").alias(V.TENANT), one.cast("string").alias(V.BATCH),
                                        one.cast("int").alias(V.LOAD), F.col("id").alias("cost"))
    out = V.newest(loads)
    assert "SortMergeJoin" not in _plan(out)
    assert out.count() == 200_000


def test_rows_are_not_dealt_by_stream(spark, no_guess):
    rows = spark.range(200_000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    out = SC.minmax_scale(rows, ["x"], ["k"])
    assert "SortMergeJoin" not in _plan(out)
    assert out.agg(F.min("x_scaled"), F.max("x_scaled"), F.count("x_scaled")).first()[:] == (0.0, 1.0, 200_000)


def test_moments_of_batches_equal_plain_ones():
    import pyarrow as pa
    rng = np.random.default_rng(5)
    k, rows = 7, []
    for stream, bucket, n in ((1, 0, 40), (1, 1, 9), (2, 0, 1), (2, 1, 30), (3, 1, 3)):
        big = rng.choice([10, 10 ** 13, W.NEAR, 1 << 45], n)
        for i in range(n):
            u = None if rng.random() < 0.2 else int(rng.integers(-big[i], big[i]))
            rows.append((stream, bucket, bucket > 0 and i < k, u))
    fields = ["_stream", "_bucket", "_halo", "_u"]

    def batch(some):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate(
            (pa.int64(), pa.int64(), pa.bool_(), pa.int64()))] + [pa.array(range(len(some)))], names=[*fields, "place"])

    want = []
    for i, (stream, bucket, halo, _) in enumerate(rows):
        first = next(j for j, r in enumerate(rows) if r[:2] == (stream, bucket))
        seen = [r[3] for r in rows[max(first, i - k):i] if r[3] is not None]
        upper, lower = divmod(len(seen) * sum(v * v for v in seen) - sum(seen) ** 2, 1 << 32)
        if not halo:
            want.append((len(seen), sum(seen), float(upper) * 4294967296.0 + float(lower)))
    for size in (1, 3, 8, 200):
        got = [r for b in W.moments_before((batch(rows[i:i + size]) for i in range(0, len(rows), size)), k)
               for r in zip(*(b.column(c).to_pylist() for c in ("_n", "_s", "_spread")))]
        assert got == want


def test_forest_depths_equal_a_plain_walk():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50):
        rows = []
        for t in range(5):
            X = np.c_[rng.lognormal(5, 1, n), rng.integers(0, 4, n)]
            nodes = IF._build_tree(X, np.random.default_rng([1, t]), math.ceil(math.log2(max(n, 2))))
            rows.append(dict(zip(["tree", "psi", "feature", "threshold", "left", "right", "value"], (t, n, *nodes))))
        X = np.c_[rng.lognormal(5, 1, 700), rng.integers(0, 4, 700)].astype(float)
        X[0], X[1], X[2] = np.nan, np.inf, -np.inf
        for i, (f, x) in enumerate((f, x) for r in rows for f, x in zip(r["feature"], r["threshold"]) if f >= 0):
            X[3 + i % 600, f] = x       # on a threshold

        def walk(r, x):
            at = 0
            while r["feature"][at] >= 0:
                at = r["left" if x[r["feature"][at]] <= r["threshold"][at] else "right"][at]
            return r["value"][at]

        want = np.array([[walk(r, x) for x in X] for r in rows]).mean(axis=0)
        assert np.array_equal(IF._forest(rows, 2).depths(X), want)


def test_ids_of_a_table_are_not_broadcast(spark):
    ids = spark.range(1000).select(F.col("id").alias(KD.ID))
    rows = spark.range(900, 1100).select(F.col("id").alias(KD.ID), F.lit("x").alias("v"))
    out = KD.unseen(rows.unionByName(rows), ids)
    assert "Broadcast" not in _plan(out)
    assert sorted(r[KD.ID] for r in out.collect()) == list(range(1000, 1100))
    assert "Broadcast" not in _plan(out)


def _spend_rows(spark):
    """Streams of 1, 3 and hundreds of rows, a null key, ties, equal rows and null costs."""
    import random
    rnd = random.Random(8)
    rows = []
    for p, n in (("AWS", 300), (None, 90), ("GCP", 3), ("Azure", 1)):
        for i in range(n):
            c = rnd.choice([None, 1.5, round(rnd.random() * 900, 2), -float(i)])
            rows.append((p, "COMPUTE", f"2024-01-{1 + i % 28:02d} 00:00:00", c, "prod", "x", int(c is not None and c > 800), "none"))
    rows += rows[:40]
    return spark.createDataFrame(rows, "cloud_provider string, unified_category string, timestamp string, cost double, normalized_env string, "
                                 "normalized_team string, is_anomaly int, anomaly_type string").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp")).repartition(5)


def test_row_features_in_passing_equal_plain_windows(spark):
    """Partitions hold a few rows of a stream, so most frames reach over cuts; the
    result is a scan of tables and not another shuffle of the rows."""
    from pyspark.sql import Window
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    keys = ["cloud_provider", "unified_category"]
    df = _spend_rows(spark)
    w = Window.partitionBy(*keys).orderBy("timestamp", "cost", "is_anomaly")
    back = w.rowsBetween(-7, -1)
    want = df.select("*", (F.row_number().over(w) - 1).alias("_pos"), F.coalesce(F.avg("cost").over(back), F.lit(0.0)).alias("m"),
                     F.coalesce(F.stddev_samp("cost").over(back), F.lit(0.0)).alias("s"))
    want = sorted((str(r["cloud_provider"]), r["_pos"], r["cost"], r["m"], r["s"]) for r in want.collect())
    try:
        for parts in (1, 4, 97):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = W.rolling_features(df, keep_index=True)
            lean = W.rolling_features(df)
            assert "Exchange hashpartitioning" not in _plan(lean) and "Exchange hashpartitioning" not in _plan(got)
            rows = sorted((str(r["cloud_provider"]), r["_pos"], r["cost"], r["rolling_mean_7d"], r["rolling_std_7d"]) for r in got.collect())
            assert len(rows) == len(want) == 434
            for a, b in zip(rows, want):
                assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9 and abs(a[4] - b[4]) < 1e-6
            assert sorted(map(str, lean.collect())) == sorted(map(str, got.drop("_pos").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sequences_equal_plain_lags(spark):
    """Windows of scaled features, nulls included, over buckets of 16 rows; plain
    values are shuffled and no window operator runs."""
    from pyspark.sql import Window
    keys = ["cloud_provider", "unified_category"]
    feat = W.rolling_features(_spend_rows(spark), keep_index=True)
    names = ["cost", "cost_ratio", "rolling_mean_7d"]
    seq = W.sequences(feat, names, scale=True, bucket_rows=16)
    assert "Window" not in _plan(seq).replace("window", "") and "_scaled" not in _plan(seq).split("Exchange", 1)[1]
    w = Window.partitionBy(*keys).orderBy("_pos")
    scaled = SC.minmax_scale(feat, names, keys)
    want = scaled.select("*", F.when(F.col("_pos") >= 14, F.array(*[
        F.lag(f"{f}_scaled", k).over(w) for k in range(14, 0, -1) for f in names])).alias("window"))
    assert sorted(map(str, seq.collect())) == sorted(map(str, want.select(*seq.columns).collect()))
    plain = W.sequences(scaled, [f"{f}_scaled" for f in names], bucket_rows=16)
    assert sorted(map(str, plain.collect())) == sorted(map(str, want.select(*plain.columns).collect()))


def test_rows_beyond_a_sort_get_tasks_of_their_own(spark):
    from costlens.operators import positional as P
    df = spark.range(10)
    assert P.more_tasks(df, 10 * P.SORT_ROWS) == [10] and P.more_tasks(df, 10) == []
