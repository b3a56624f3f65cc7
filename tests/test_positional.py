"""Bucketed positional windows equal plain per-stream windows."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from costlens.operators import aggregates as A
from costlens.operators import positional as P


def _data(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abc"), rnd.randint(0, 50), rnd.random()) for _ in range(n)]
    return spark.createDataFrame(rows, "k string, t int, v double")


def test_index_matches_row_number(spark):
    df = _data(spark)
    got = P.positional_index(df, ["k"], ["t", "v"]).select("k", "t", "v", "_pos")
    w = Window.partitionBy("k").orderBy("t", "v")
    exp = df.withColumn("_pos", F.row_number().over(w) - 1)
    assert sorted(got.collect()) == sorted(exp.collect())


def test_halo_frames_match_plain_windows(spark):
    df = _data(spark)
    idx = P.positional_index(df, ["k"], ["t", "v"])

    def build(w):
        return [F.sum("v").over(w.rowsBetween(-5, -1)).alias("back"),
                F.sum("v").over(w.rowsBetween(1, 3)).alias("ahead")]

    got = P.framed(idx, ["k"], build, before=5, after=3, bucket_rows=7).drop("_pos")
    w = Window.partitionBy("k").orderBy("t", "v")
    exp = df.select("*", F.sum("v").over(w.rowsBetween(-5, -1)).alias("back"),
                    F.sum("v").over(w.rowsBetween(1, 3)).alias("ahead"))

    def key(r):
        return (r["k"], r["t"], r["v"])
    g = {key(r): (r["back"], r["ahead"]) for r in got.collect()}
    e = {key(r): (r["back"], r["ahead"]) for r in exp.collect()}
    assert g.keys() == e.keys()
    for k in g:
        for x, y in zip(g[k], e[k]):
            assert (x is None and y is None) or abs(x - y) < 1e-9


def test_exact_percentile_matches_numpy(spark):
    import numpy as np
    df = _data(spark, 501)
    for p in (0.95, 0.5, 0.0, 1.0):
        got = {r["k"]: r["threshold"] for r in A.exact_percentile(df, "v", p, ["k"]).collect()}
        for k in "abc":
            vals = np.array([r["v"] for r in df.where(F.col("k") == k).collect()])
            assert abs(got[k] - np.percentile(vals, 100 * p)) < 1e-12


def test_percentile_of_ties_signs_and_extremes(spark):
    """97 % ties, both signs, zeros, subnormal and huge values, a null key, one
    value, and no value at all; few cuts, so that several passes are needed."""
    import numpy as np

    from costlens.operators import rankselect
    rnd = random.Random(4)
    groups = {"ties": [3.25] * 970 + [rnd.random() for _ in range(30)],
              "mixed": [rnd.choice([-1, 1]) * rnd.random() * 10.0 ** rnd.randint(-320, 300) for _ in range(400)] + [0.0, -0.0, 5e-324],
              "close": [1.0 + i * 2.0 ** -52 for i in range(300)], "one": [-7.5], None: [float(i) for i in range(101)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("empty", None), ("ties", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for cuts in (8, rankselect.CUTS):
        rankselect_cuts, rankselect.select_ranks.__defaults__ = rankselect.select_ranks.__defaults__, ("_v", cuts)
        try:
            for p in (0.95, 0.5, 0.013, 0.0, 1.0):
                got = {r["k"]: r["threshold"] for r in A.exact_percentile(df, "v", p, ["k"]).collect()}
                assert set(got) == set(groups)
                for k, vs in groups.items():
                    vs, at = sorted(vs), (len(vs) - 1) * p
                    a, b = vs[int(np.floor(at))], vs[int(np.ceil(at))]
                    assert got[k] == a + (b - a) * (at - np.floor(at)), (k, p)
        finally:
            rankselect.select_ranks.__defaults__ = rankselect_cuts
    alone = A.exact_percentile(df.where("k = 'close'"), "v", 0.5).collect()
    assert len(alone) == 1 and alone[0]["threshold"] == sum(sorted(groups["close"])[149:151]) / 2


def test_percentile_shuffles_counts_only(spark):
    """No range exchange: the scored rows are never sorted by value."""
    from costlens.operators import detect as D
    df = spark.createDataFrame([("AWS", "COMPUTE", float(i % 7)) for i in range(500)],
                               "cloud_provider string, unified_category string, s double")
    plan = D.contamination_flag(df, "s")._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan.lower()


def test_ties_are_split_over_partitions(spark):
    """97 % of the rows share their sort key, most of them all columns: no
    partition of the index holds over twice the mean, and positions are gapless."""
    rows = [("k", 5, float(i % 3)) for i in range(9700)] + [("k", i, 0.5) for i in range(200)] + [(None, 1, 1.0)] * 100
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(6)
    seen = []
    kept = P.materialize

    def spy(frame, name):
        out = kept(frame, name)
        seen.extend(r["n"] for r in out.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
        return out
    P.materialize = spy
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # small partitions would be joined
    try:
        got = P.positional_index(df, ["k"], ["t"]).collect()
    finally:
        P.materialize = kept
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(seen) <= 2 * len(rows) / 8
    for k in ("k", None):
        own = sorted(r["_pos"] for r in got if r["k"] == k)
        assert own == list(range(len(own)))
        assert [r["t"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["_pos"])] == sorted(r[1] for r in rows if r[0] == k)


def test_scale_invariance(spark):
    from costlens.plans.q_windows import null_fill
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(map(tuple, null_fill(spark, "/root/testdata/sf0.001").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    b = sorted(map(tuple, null_fill(spark, "/root/testdata/sf0.001").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_hot_stream_is_split_into_bounded_window_groups(spark):
    """One stream holds ~90 % of the rows: every window partition of the
    bucketed frame stays within bucket_rows + halo rows."""
    rows = [("hot" if i % 10 else "cold", i, float(i % 97)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    idx = P.positional_index(df, ["k"], ["t"])
    b, before = 256, 7
    bucket = F.floor(F.col("_pos") / b)
    pos_in = F.col("_pos") - bucket * b
    copies = idx.select("k", F.explode(F.when(pos_in >= b - before, F.array(bucket, bucket + 1))
                                       .otherwise(F.array(bucket))).alias("_bucket"))
    sizes = [r["n"] for r in copies.groupBy("k", "_bucket").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= b + before
    assert len(sizes) >= 4500 // b
