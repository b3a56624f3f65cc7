"""Properties of the model tiers."""
import numpy as np
from pyspark.sql import functions as F

from sfdata import SF_SMALL
from costlens.operators import forecast_models as M
from costlens.operators import stl
from costlens.plans import q_models as QM


def test_stl_components_and_spike():
    rng = np.random.default_rng(1)
    n = 300
    y = 1000 + 2.0 * np.arange(n) + np.tile([50, 40, 30, 20, 10, -80, -70], n // 7 + 1)[:n] + rng.normal(0, 5, n)
    tr, se, re = stl.decompose(y)
    assert np.abs(tr + se + re - y).max() < 1e-8
    assert np.abs(re).std() < 10
    y[150] += 800
    _, _, re = stl.decompose(y)
    assert re[150] > 600


def test_forest_flags_and_scores(spark):
    out = QM.isolation_forest(spark, SF_SMALL)
    g = out.groupBy("cloud_provider", "unified_category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ml_is_anomaly").alias("f"),
        F.min("iforest_score").alias("lo"), F.max("iforest_score").alias("hi")).collect()
    for r in g:
        assert r["f"] <= 0.05 * r["n"] + 1
        assert 0 < r["lo"] <= r["hi"] <= 1


FEATURES = ["cost", "rolling_mean_7d"]


def _stream(spark, rows):
    return spark.createDataFrame([(p, "COMPUTE", float(i), float(v), float(v) / 2) for p, i, v in rows],
                                 "cloud_provider string, unified_category string, _pos double, cost double, rolling_mean_7d double")


def test_trees_draw_from_the_whole_stream(spark):
    """No pool: the samples of 100 trees together hold rows from every part of
    a long stream, far more than any one tree's, each tree has 256 of them and
    copies of one row are drawn one by one."""
    from costlens.operators import iforest as IF
    n = 30000
    df = _stream(spark, [("AWS", i, i) for i in range(n)] + [("GCP", i, 1.0 if i % 100 else 2.0) for i in range(5000)])
    got = IF.tree_candidates(df, FEATURES).toPandas()
    own = got[got["cost"].max() == got["cost"]]
    a = got.groupby("_stream")["cost"].max().idxmax()
    own = got[got["_stream"] == a]
    drawn = own.sort_values("_u").groupby("tree").head(256)
    assert drawn.groupby("tree").size().eq(256).all() and drawn["tree"].nunique() == 100
    assert drawn["cost"].nunique() > 12000                       # of 25,600 draws out of 30,000 rows
    share = np.histogram(drawn["cost"], bins=10, range=(0, n))[0] / len(drawn)
    assert share.min() > 0.08 and share.max() < 0.12
    other = got[got["_stream"] != a].sort_values("_u").groupby("tree").head(256)
    ones = (other["cost"] == 1.0).groupby(other["tree"]).mean()
    assert 0.9 < ones.min() and ones.mean() < 1.0                # 99 % of the rows are alike
    forest = IF.fit_forest(df, FEATURES).select("tree", "psi").collect()
    assert len(forest) == 200 and {r["psi"] for r in forest} == {256}


def test_forest_scores_are_finite(spark):
    """One row, rows alike in every feature, a null key, and several parts."""
    from costlens.operators import iforest as IF
    rows = [("one", 0, 5.0)] + [("flat", i, 7.0) for i in range(300)] + [(None, i, float(i == 9) * 50) for i in range(60)]
    df = _stream(spark, rows)
    bound, IF.MODEL_BYTES = IF.MODEL_BYTES, 20_000
    try:
        parts = {(r["cloud_provider"], r["_pos"]): r["iforest_score"] for r in IF.isolation_forest(df, features=FEATURES).collect()}
    finally:
        IF.MODEL_BYTES = bound
    whole = {(r["cloud_provider"], r["_pos"]): r["iforest_score"] for r in IF.isolation_forest(df, features=FEATURES).collect()}
    assert parts == whole and len(whole) == len(rows)
    assert whole["one", 0.0] == 0.5 and all(abs(whole["flat", float(i)] - 0.5) < 1e-9 for i in range(300))
    assert all(0 < v < 1 for v in whole.values()) and max(whole[None, float(i)] for i in range(60)) == whole[None, 9.0]


def test_reconstruction_warmup_and_share(spark):
    out = QM.sequence_reconstruction(spark, SF_SMALL)
    g = out.groupBy("cloud_provider", "unified_category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dl_is_anomaly").alias("f"),
        F.sum((F.col("dl_mse_score") == 0).cast("int")).alias("z")).collect()
    for r in g:
        assert r["z"] >= min(14, r["n"])
        assert r["f"] <= 0.05 * r["n"] + 1


def test_forecast_bands(spark):
    out = QM.production_forecast(spark, SF_SMALL)
    g = out.groupBy("cloud_provider", "unified_category").agg(F.countDistinct("date").alias("d")).collect()
    assert all(r["d"] == 90 for r in g)
    assert out.where((F.col("lower_bound") < 0) | (F.col("lower_bound") > F.col("predicted_cost"))
                     | (F.col("predicted_cost") > F.col("upper_bound"))).count() == 0


def test_wmape_and_tie_rule():
    assert M.wmape(np.zeros(3), np.ones(3)) == 0.0
    assert M.wmape(np.array([1.0, 2.0]), np.array([1.5, 1.0])) >= 0
    y = np.array([5.0, 6.0, 7.0])
    from costlens import fixed
    assert (fixed.ADDITIVE_MODEL if M.wmape(y, y) < M.wmape(y, y) else fixed.GBT_MODEL) == fixed.GBT_MODEL


def test_boosted_trees_fit_a_step():
    X = np.arange(200, dtype=float).reshape(-1, 1)
    y = np.where(X[:, 0] < 100, 1.0, 5.0)
    p = M.BoostedTrees(rounds=50).fit(X, y).predict(X)
    assert abs(p[:90].mean() - 1.0) < 0.5 and abs(p[110:].mean() - 5.0) < 0.5


def test_forest_invariant_to_partitioning(spark):
    """Content-hash pool and seeded trees: same flags with 1 or 24 shuffle partitions."""
    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        out = QM.isolation_forest(spark, SF_SMALL)
        return sorted((r["timestamp"], r["cloud_provider"], r["unified_category"], r["cost"],
                       r["normalized_env"], r["ml_is_anomaly"], round(r["iforest_score"], 12))
                      for r in out.collect())
    a, b = run(1), run(24)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_windows_in_passing_equal_stored_ones(spark):
    """Scores from the rolling buffer over small buckets are those of windows
    that are stored row by row, with labelled rows left out of the training."""
    import random

    from costlens.operators import reconstruct as RC
    from costlens.operators import scale as SC
    from costlens.operators import windows as W
    from costlens.operators.positional import positional_index
    rnd = random.Random(9)
    rows = [(p, "COMPUTE", i, rnd.random() * 50, rnd.random() * 9, i % 7, int(i % 7 > 4), int(rnd.random() < 0.2))
            for p in ("AWS", None) for i in range(150)] + [("GCP", "COMPUTE", i, 1.0, 1.0, 0, 0, 0) for i in range(9)]
    df = spark.createDataFrame(rows, "cloud_provider string, unified_category string, t int, cost double, rolling_mean_7d double, "
                               "day_of_week int, is_weekend int, is_anomaly int")
    df = df.withColumn("rolling_std_7d", F.col("rolling_mean_7d") / 3).withColumn("cost_ratio", F.col("cost") / 7)
    keys = ["cloud_provider", "unified_category"]
    idx = positional_index(df, keys, ["t"])
    new = {(r["cloud_provider"], r["t"]): r for r in RC.sequence_reconstruction(idx, bucket_rows=16).collect()}
    one = {(r["cloud_provider"], r["t"]): r for r in RC.sequence_reconstruction(idx).collect()}
    assert len(new) == len(rows) and new.keys() == one.keys()
    assert all(abs(new[k]["dl_mse_score"] - one[k]["dl_mse_score"]) < 1e-9 and new[k]["dl_is_anomaly"] == one[k]["dl_is_anomaly"] for k in new)
    # stored windows
    scaled = SC.minmax_scale(df, RC.fixed.SEQ_FEATURES, keys)
    for p in ("AWS", None):
        own = scaled.where(F.col("cloud_provider").eqNullSafe(F.lit(p)))
        clean = W.sequences(own.where("is_anomaly = 0"), RC.SCALED, keys, order=["t"]).where("window IS NOT NULL").toPandas()
        X = np.stack(clean["window"].to_numpy())
        cov = (X - X.mean(0)).T @ (X - X.mean(0)) / len(X)
        vals, vecs = np.linalg.eigh(cov)
        basis = vecs[:, np.argsort(vals)[::-1][:RC.fixed.SEQ_HIDDEN]]
        full = W.sequences(own, RC.SCALED, keys, order=["t"]).where("window IS NOT NULL").toPandas()
        Y = np.stack(full["window"].to_numpy()) - X.mean(0)
        err = ((Y - (Y @ basis) @ basis.T) ** 2).mean(1)
        assert len(full) == 136
        for t, e in zip(full["t"], err):
            assert abs(new[p, t]["dl_mse_score"] - e) < 1e-8
    assert all(new["GCP", i]["dl_mse_score"] == 0 and new["GCP", i]["dl_is_anomaly"] == 0 for i in range(9))
