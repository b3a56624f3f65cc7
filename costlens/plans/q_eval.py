"""Queries: contamination cut, evaluation metrics and labelled perturbation
(I5, E4-E6, E9, C6, I12, J5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.operators import aggregates as A
from costlens.operators import detect as D
from costlens.operators import labels as L
from costlens.operators import windows as W
from costlens.plans import sqlparts as Q
from costlens.plans.catalog import query
from costlens.session import materialize
from costlens.sources import tables as T

FLAGS = ["stat_is_anomaly", "ml_is_anomaly", "dl_is_anomaly", "ensemble_is_anomaly"]

EVAL = [("spend", Q.spend(team=False)), ("feat", Q.row_features()), ("daily", Q.daily()),
        ("resid", Q.seasonal()), ("scores", Q.day_scores()), ("flags", Q.stat_rows("feat")),
        ("th", "SELECT cloud_provider, unified_category, quantile_cont(cost_ratio, 0.95) AS _th "
               "FROM flags GROUP BY ALL"),
        ("ev", "SELECT f.*, CAST(f.cost_ratio > t._th AS INTEGER) AS ml_is_anomaly FROM flags f "
               "LEFT JOIN th t USING (cloud_provider, unified_category)")]

# three tiers by exactly computable scores, and their vote
VOTE = [*EVAL, ("dev", "SELECT *, ABS(cost - rolling_mean_7d) AS mean_gap FROM ev"),
        ("th3", "SELECT cloud_provider, unified_category, quantile_cont(mean_gap, 0.95) AS _th3 FROM dev GROUP BY ALL"),
        ("tiers", "SELECT d.*, CAST(mean_gap > _th3 AS INTEGER) AS dl_is_anomaly FROM dev d "
                  "LEFT JOIN th3 USING (cloud_provider, unified_category)"),
        ("vote", "SELECT *, CASE WHEN stat_is_anomaly = 1 OR (ml_is_anomaly = 1 AND dl_is_anomaly = 1) THEN 1 ELSE 0 END "
                 "AS ensemble_is_anomaly FROM tiers")]


def eval_frame(spark, sf_dir):
    """Spend rows with tier-2 features, the statistical flag (I3 window
    version) and the contamination cut of cost_ratio as second tier."""
    sp = materialize(T.spend(T.Tables(spark, sf_dir), team=False), "spend-rows")
    feat = W.rolling_features(sp, written=True)
    cut = D.contamination_flag(feat, "cost_ratio", written=True)
    return D.broadcast_day_score(cut, D.day_scores(sp)).select(*feat.columns, "stat_z_score", "stat_is_anomaly", "ml_is_anomaly")


@query("contamination_flag", Q.with_(*EVAL, final="SELECT * FROM ev"))
def contamination_flag(spark, sf_dir):
    """Flag rows whose score (here cost_ratio) is above the stream's 95th
    percentile (5 % contamination), exact distributed percentile."""
    return eval_frame(spark, sf_dir)


@query("percentile_threshold", Q.with_(*EVAL, final="""SELECT cloud_provider, unified_category,
  ROUND(_th, 9) AS threshold FROM th"""))
def percentile_threshold(spark, sf_dir):
    """Linear-interpolated 95th percentile of the score per stream."""
    feat = W.rolling_features(T.spend(T.Tables(spark, sf_dir), team=False))
    th = A.exact_percentile(feat, "cost_ratio", 0.95, ["cloud_provider", "unified_category"], written=True)
    # reported to 9 decimals: engines interpolate the last bit differently
    return th.withColumn("threshold", F.round("threshold", 9))


def vote_frame(spark, sf_dir):
    """Spend rows with three exact tiers (the statistical flag, and the
    contamination cuts of ``cost_ratio`` and of the distance from the rolling
    mean) and the vote. Row features are computed once and written once."""
    sp = materialize(T.spend(T.Tables(spark, sf_dir), team=False), "spend-rows")
    feat = W.rolling_features(sp, written=True).withColumn("mean_gap", F.abs(F.col("cost") - F.col("rolling_mean_7d")))
    cut = D.contamination_flags(feat, {"ml_is_anomaly": "cost_ratio", "dl_is_anomaly": "mean_gap"}, written=True)
    return D.ensemble_vote(D.broadcast_day_score(cut, D.day_scores(sp)))


LONG = ("long", "\nUNION ALL\n".join(
    f"SELECT '{f}' AS tier, cloud_provider, unified_category, is_anomaly = 1 AS y, {f} = 1 AS p FROM vote" for f in FLAGS))


def _counts_sql(by, sets=None):
    return f"""SELECT {by}, COUNT(*) FILTER (WHERE y AND p) AS tp, COUNT(*) FILTER (WHERE NOT y AND p) AS fp,
  COUNT(*) FILTER (WHERE y AND NOT p) AS fn, COUNT(*) FILTER (WHERE NOT y AND NOT p) AS tn
FROM long GROUP BY {sets or by}"""


RATIOS = """CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END AS f1"""


@query("confusion", Q.with_(*VOTE, LONG, final=_counts_sql("tier")))
def confusion(spark, sf_dir):
    """TP / FP / FN / TN of each tier's and the vote's flag against the label."""
    return A.evaluate(vote_frame(spark, sf_dir), FLAGS).select("tier", "tp", "fp", "fn", "tn")


@query("precision_recall_f1", Q.with_(*VOTE, LONG, ("counts", _counts_sql("tier")),
                                      final=f"SELECT tier, tp, fp, fn, {RATIOS} FROM counts"))
def precision_recall_f1(spark, sf_dir):
    """E5: precision, recall and F1 per tier and of the vote, 0 where undefined."""
    return A.precision_recall_f1(vote_frame(spark, sf_dir), FLAGS)


_CAUGHT = "COUNT(*) FILTER (WHERE is_anomaly = 1 AND {f} = 1)"


@query("detection_rate", Q.with_(*VOTE, final="SELECT COUNT(*) FILTER (WHERE is_anomaly = 1) AS true_anomalies,\n  "
                                 + ",\n  ".join(f"{_CAUGHT.format(f=f)} AS caught_{f}" for f in FLAGS) + ",\n  "
                                 + ",\n  ".join(f"CAST({_CAUGHT.format(f=f)} AS DOUBLE) / GREATEST(1, COUNT(*) FILTER "
                                                f"(WHERE is_anomaly = 1)) * 100 AS rate_{f}" for f in FLAGS) + " FROM vote"))
def detection_rate(spark, sf_dir):
    """Caught / max(1, injected) x 100 per tier and of the vote."""
    return A.detection_rate(vote_frame(spark, sf_dir), FLAGS)


@query("true_anomalies", Q.with_(*VOTE, final=f"""SELECT "timestamp", cloud_provider, unified_category,
  cost, anomaly_type, {', '.join(FLAGS)} FROM vote WHERE is_anomaly = 1"""))
def true_anomalies(spark, sf_dir):
    """Labelled rows with what each tier and the vote said about them."""
    return vote_frame(spark, sf_dir).where(F.col("is_anomaly") == 1).select(
        "timestamp", "cloud_provider", "unified_category", "cost", "anomaly_type", *FLAGS)


@query("ensemble_vote", Q.with_(*VOTE, final=f"""SELECT "timestamp", cloud_provider, unified_category, cost, is_anomaly,
  anomaly_type, {', '.join(FLAGS)} FROM vote"""))
def ensemble_vote(spark, sf_dir):
    """Stat OR (ml AND dl) on every row, over the three exact tiers."""
    return vote_frame(spark, sf_dir).select(
        "timestamp", "cloud_provider", "unified_category", "cost", "is_anomaly", "anomaly_type", *FLAGS)


@query("tier_evaluation", Q.with_(*VOTE, LONG, ("counts", _counts_sql(
    "tier, cloud_provider, unified_category, CAST(GROUPING(cloud_provider) AS INTEGER) AS is_total",
    "GROUPING SETS ((tier), (tier, cloud_provider, unified_category))")),
    final=f"""SELECT tier, cloud_provider, unified_category, is_total, tp, fp, fn, tn, {RATIOS},
  tp + fn AS true_anomalies, tp AS caught, CAST(tp AS DOUBLE) / GREATEST(1, tp + fn) * 100 AS rate FROM counts"""))
def tier_evaluation(spark, sf_dir):
    """Every tier and the vote, per stream and over all rows, from
    one pass with grouping sets."""
    return A.evaluate(vote_frame(spark, sf_dir), FLAGS, keys=["cloud_provider", "unified_category"])


PERTURB = [("spend", Q.spend(team=False)), ("d", Q.daily_flag()),
           ("dr", "SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS _dr FROM (SELECT DISTINCT date FROM d)"),
           ("sr", f"SELECT {Q.S}, ROW_NUMBER() OVER (ORDER BY {Q.S}) - 1 AS _sr FROM (SELECT DISTINCT {Q.S} FROM d)"),
           ("c", """SELECT (SELECT COUNT(*) FROM sr) AS _ns, (SELECT MAX(date) FROM dr WHERE _dr = 45) AS _spike,
  (SELECT MAX(date) FROM dr WHERE _dr = 140) AS _ctx0"""),
           ("c2", "SELECT _ns, _spike, CAST(_ctx0 + CAST(6 - (isodow(_ctx0) - 1) AS INTEGER) AS DATE) AS _ctx FROM c"),
           ("x", f"""SELECT d.*, _dr * _ns + _sr AS _idx, _dr - 100 AS _di, _spike, _ctx
FROM d JOIN dr USING (date) JOIN sr USING ({Q.S}), c2"""),
           ("f", """SELECT *, CASE WHEN date = _ctx THEN CAST(1.55 AS DOUBLE)
    WHEN _di >= 0 AND _di < 15 AND _idx % 2 = 0 THEN CAST(1.05 AS DOUBLE) + _di * CAST(0.025 AS DOUBLE)
    WHEN date = _spike AND _idx % 3 = 0 THEN CAST(3.5 AS DOUBLE) END AS _f,
  CASE WHEN date = _ctx THEN 'contextual' WHEN _di >= 0 AND _di < 15 AND _idx % 2 = 0 THEN 'drift'
    WHEN date = _spike AND _idx % 3 = 0 THEN 'spike' END AS _kind FROM x"""),
           ("perturbed", f"""SELECT {Q.S}, date,
  CASE WHEN _f IS NOT NULL THEN CAST(ROUND(cost_cents * _f) AS BIGINT) ELSE cost_cents END AS cost_cents,
  CAST(CASE WHEN _f IS NOT NULL THEN CAST(ROUND(cost_cents * _f) AS BIGINT) ELSE cost_cents END AS DOUBLE) / 100 AS cost,
  CAST(CASE WHEN _f IS NOT NULL THEN 1 ELSE had_anomaly END AS INTEGER) AS is_anomaly,
  COALESCE(_kind, CASE WHEN had_anomaly = 1 THEN 'spike' ELSE 'none' END) AS anomaly_type FROM f""")]


def perturbed_daily(spark, sf_dir):
    return L.perturb_labelled(A.daily_cost_flag(T.spend(T.Tables(spark, sf_dir), team=False)))


@query("perturb_labelled", Q.with_(*PERTURB, final="SELECT * FROM perturbed"))
def perturb_labelled(spark, sf_dir):
    """Spike / drift / contextual labelled anomalies added to the daily
    cost table by the generator's row-numbering rule."""
    return perturbed_daily(spark, sf_dir)
