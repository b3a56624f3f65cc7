"""Frames formed in a scan of the sorted table, and what queries leave on disk."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sfdata import SF_SMALL
from costlens import session
from costlens.operators import positional as P
from costlens.operators import reconstruct as RC
from costlens.operators import scale as SC
from costlens.operators import windows as W
from costlens.plans import q_models as QM
from costlens.plans import q_windows as QW

KEYS = ["cloud_provider", "unified_category"]
NAMES = ["cost", "cost_ratio", "rolling_mean_7d"]


@pytest.fixture
def parted(spark):
    """Sets the number of partitions, which adaptive execution leaves alone."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def small_parts(monkeypatch):
    """Row groups of 112 rows."""
    monkeypatch.setattr(P, "DEFAULT_BUCKET_ROWS", 1)


def _rows(spark):
    """Long and short streams, a null key, ties, equal rows, null costs and a long run of labelled rows."""
    rnd = random.Random(8)
    rows = []
    for p, n in (("AWS", 900), (None, 90), ("GCP", 3), ("Azure", 1)):
        for i in range(n):
            c = rnd.choice([None, 1.5, round(rnd.random() * 900, 2), -float(i)])
            label = int(200 < i < 420 or rnd.random() < 0.1) if i % 9 else None
            rows.append((p, "COMPUTE", f"2024-{1 + i // 75:02d}-{1 + i % 75 // 3:02d} 00:00:00", c, "prod", "x", label, "none"))
    rows += rows[:40]
    return spark.createDataFrame(rows, "cloud_provider string, unified_category string, timestamp string, cost double, normalized_env string, "
                                 "normalized_team string, is_anomaly int, anomaly_type string").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp")).repartition(5)


def _scanned(df):
    """Whether the plan shuffles nothing but the few rows at the edges of partitions."""
    plan = df._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    main, *shuffled = plan.split("Exchange ")
    return "MapInArrow" in main and "_len" not in main and len(shuffled) == 1 and "_len" in shuffled[0]


def test_sequences_in_a_scan_equal_plain_lags(spark, parted, small_parts):
    for parts in (1, 4, 97):
        parted(parts)
        of = W.ordered_features(_rows(spark), reach=14)
        seq = W.sequences(of, NAMES, scale=True)
        assert _scanned(seq)
        feat = of.rows("_pos")
        w = Window.partitionBy(*KEYS).orderBy("_pos")
        want = SC.minmax_scale(feat, NAMES, KEYS).select("*", F.when(F.col("_pos") >= 14, F.array(*[
            F.lag(f"{f}_scaled", k).over(w) for k in range(14, 0, -1) for f in NAMES])).alias("window"))
        assert sorted(map(str, seq.collect())) == sorted(map(str, want.select(*seq.columns).collect()))
        plain = W.sequences(of, NAMES).collect()
        assert len(plain) == 1034 and sum(r["window"] is not None for r in plain) == 926 + 76


def test_kept_rows_in_a_scan_equal_plain_lags(spark, parted, small_parts):
    """Frames over the rows that meet a condition, however long the others between."""
    for parts in (1, 4, 97):
        parted(parts)
        of = W.ordered_features(_rows(spark), reach=14, kept=F.col("is_anomaly") == 0)
        run = lambda b: W.rows_before(b, NAMES, 14, "window")
        got = of.in_passing(run, of.rows().columns, [P.T.StructField("window", P.T.ArrayType(P.T.DoubleType()))], kept=True)
        w = Window.partitionBy(*KEYS).orderBy("_pos")
        want = of.rows("_pos").where("is_anomaly = 0").withColumn("_nth", F.row_number().over(w)).select("*", F.when(F.col("_nth") > 14, F.array(*[
            F.lag(f, k).over(w) for k in range(14, 0, -1) for f in NAMES])).alias("window")).select(*got.columns)
        rows = sorted(map(str, got.collect()))
        assert rows == sorted(map(str, want.collect())) and len(rows) > 500


def test_reconstruction_in_a_scan_equals_the_one_by_buckets(spark, parted, small_parts):
    df = _rows(spark).fillna(2.5, ["cost"])
    for parts in (4, 97):
        parted(parts)
        of = W.ordered_features(df, reach=14, kept=F.col("is_anomaly") == 0)
        cols = [*df.columns, "cost_scaled", "dl_is_anomaly"]
        new, old = (sorted((*(str(r[c]) for c in cols), r["dl_mse_score"]) for r in RC.sequence_reconstruction(x, bucket_rows=64).collect())
                    for x in (of, of.rows("_pos")))
        assert len(new) == len(old) == 1034
        assert all(a[:-1] == b[:-1] and abs(a[-1] - b[-1]) < 1e-9 for a, b in zip(new, old))


def test_rows_out_of_order_are_an_error():
    import pyarrow as pa

    def batch(places, halo):
        n = len(places)
        return pa.RecordBatch.from_arrays([pa.array([7] * n), pa.array([0] * n), pa.array(halo), pa.array(places)],
                                          names=["_stream", "_bucket", "_halo", "_nth"])
    good = [batch([30, 31], [True, True]), batch([32, 33], [False, False])]
    assert [b.num_rows for b in P._whole(good, 2)] == [2, 2]
    for bad in ([good[1]], [good[0], batch([33], [False])]):
        with pytest.raises(RuntimeError):
            list(P._whole(bad, 2))


def _left(spark, query):
    """Names of the tables that a query leaves when it is ready to run, and the bytes of its shuffle files."""
    files = lambda: {f.getName(): f.length() for f in _files(spark) if re.fullmatch(r"shuffle_.*data", f.getName())}
    before, old = files(), set(session._CREATED)
    df = query(spark, SF_SMALL)
    left = sum(n for f, n in files().items() if f not in before)
    return df, {p.rsplit("/", 1)[1][:-33] for p in session._CREATED if p not in old}, left


def _files(spark):
    import time
    time.sleep(2)       # shuffle files go in the background
    seq = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return [seq.apply(i) for i in range(seq.size())]


def test_sequences_leave_the_sorted_table_only(spark):
    df, tables, files = _left(spark, QW.sequences_14)
    assert tables == {"positional", "positional-cuts", "group-stats"} and files < 20_000      # a row a stream
    assert _scanned(df)


def test_reconstruction_leaves_the_scored_rows(spark):
    df, tables, files = _left(spark, QM.sequence_reconstruction)
    assert "seq-scored" in tables and not tables & {"spend-rows", "positional", "positional-cuts", "seq-scaled"}
    assert files < 100_000 and df.count() == df.where("dl_mse_score >= 0").count() > 0


def test_tiers_equal_their_operators_one_by_one(spark, monkeypatch):
    """In one pass, and with the forests dealt into parts; of the rows one table stays."""
    from costlens.operators import detect as D
    from costlens.operators import iforest as IF
    sp = QM._spend(spark, SF_SMALL)
    ml = IF.isolation_forest(W.rolling_features(sp, keep_index=True), written=True)
    want = D.ensemble_vote(D.broadcast_day_score(RC.sequence_reconstruction(ml), D.day_scores(sp)))
    cols = ["timestamp", *KEYS, "cost", "is_anomaly", "stat_z_score", "iforest_score", "stat_is_anomaly", "ml_is_anomaly",
            "dl_is_anomaly", "ensemble_is_anomaly"]

    def rows(df):
        return sorted((*map(str, (r[c] for c in cols)), round(r["dl_mse_score"], 9)) for r in df.collect())
    want = rows(want)
    for bound in (IF.MODEL_BYTES, 1 << 20):
        monkeypatch.setattr(IF, "MODEL_BYTES", bound)
        df, tables, files = _left(spark, QM.tiers)
        assert "tier-scores" in tables and not tables & {"spend-rows", "positional", "positional-cuts", "seq-scaled", "seq-scored", "iforest-scored"}
        assert files < 100_000
        assert rows(df) == want


def test_release_removes_what_a_frame_reads(spark):
    import os
    one, two = (session.materialize(spark.range(9), "kept-rows") for _ in range(2))
    paths = [next(p for p in session._CREATED if p.rsplit("/", 1)[1] in f.inputFiles()[0]) for f in (one, two)]
    session.release(one.where("id > 3"))
    assert [os.path.exists(p.removeprefix("file:")) for p in paths] == [False, True]
    assert paths[0] not in session._CREATED and two.count() == 9
