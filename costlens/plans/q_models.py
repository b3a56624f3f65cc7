"""Queries: model tiers (I1, I3-STL, I4, I6, I7, I8, I10, I11, I12 and the
tier evaluation). These have no SQL twin; the driver records a rows-only
check and ``tests/`` checks their properties."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from costlens import fixed
from costlens.operators import aggregates as A
from costlens.operators import detect as D
from costlens.operators import forecast_models as M
from costlens.operators import forecast_window as FW
from costlens.operators import iforest as IF
from costlens.operators import reconstruct as RC
from costlens.operators import stl as STL
from costlens.operators import windows as W
from costlens.operators.positional import IDX
from costlens.plans.catalog import query
from costlens.session import materialize, release
from costlens.sources import tables as T


def _spend(spark, sf_dir):
    return T.spend(T.Tables(spark, sf_dir), team=False)


def _series(spark, sf_dir):
    return FW.cleaned_series(_spend(spark, sf_dir))


@query("stl_residual")
def stl_residual(spark, sf_dir):
    """Robust STL (period 7) of every stream's daily cost."""
    return STL.stl_residual(A.daily_cost(_spend(spark, sf_dir)))


@query("stat_detector_stl")
def stat_detector_stl(spark, sf_dir):
    """I3 (STL version): STL residual -> rolling z -> |z| > 3 -> every spend row."""
    sp = _spend(spark, sf_dir)
    days = STL.stl_day_scores(A.daily_cost(sp))
    return D.broadcast_day_score(sp, days)


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    """I4 + I5: per-stream isolation forest score and 5 % contamination flag
    for every spend row."""
    return IF.isolation_forest(W.rolling_features(_spend(spark, sf_dir), keep_index=True), written=True).drop(IDX)


def _ordered(sp, written=False):
    """Row features whose clean rows (D8) have frames of their own."""
    return W.ordered_features(sp, reach=fixed.SEQ_LEN, kept=F.col("is_anomaly") == 0, written=written)


@query("sequence_reconstruction")
def sequence_reconstruction(spark, sf_dir):
    """Reconstruction error of each row's previous-14-row window under a
    rank-8 linear autoencoder fit on clean windows; p95 flag."""
    feat = _ordered(_spend(spark, sf_dir))
    out = RC.sequence_reconstruction(feat)
    release(*feat.tables())
    return out


def tiers(spark, sf_dir):
    """Every spend row with the three tier flags and the vote. Each written table
    goes when the next one is written: of the rows, two at most are there at once."""
    sp = W.spend_rows(_spend(spark, sf_dir))
    days = materialize(D.day_scores(sp), "day-scores")
    feat = _ordered(sp, written=True)
    release(sp)
    forest = materialize(IF.fit_forest(feat.rows(IDX)), "iforest-trees")
    if IF.parts_of(forest) == 1:
        # both tiers score a row in one pass
        score = [ST.StructField("iforest_score", ST.DoubleType())]
        scored, _ = RC.score_in_passing(feat, IF.scorer(forest), fixed.IFOREST_FEATURES, score)
        scored = materialize(scored, "tier-scores", compression="zstd")
        release(*feat.tables())
    else:
        dl = materialize(RC.score_in_passing(feat)[0], "seq-scored", compression="zstd")
        release(*feat.tables())
        scored = materialize(IF.score_rows(feat.made_of(dl), forest).drop(*W.FEATURES), "tier-scores", compression="zstd")
        release(dl)
    ml = D.contamination_flag(scored, "iforest_score", written=True)
    return D.ensemble_vote(D.broadcast_day_score(RC.flag_scores(ml), days))


@query("ensemble_vote_models")
def ensemble_vote_models(spark, sf_dir):
    """Stat OR (forest AND reconstruction) over the three real tiers."""
    return tiers(spark, sf_dir).select(
        "timestamp", "cloud_provider", "unified_category", "cost", "is_anomaly", "anomaly_type",
        "stat_z_score", "stat_is_anomaly", "iforest_score", "ml_is_anomaly", "dl_mse_score",
        "dl_is_anomaly", "ensemble_is_anomaly")


@query("ensemble_evaluation")
def ensemble_evaluation(spark, sf_dir):
    """E5 over the real tiers: precision, recall, F1 of each tier and the vote."""
    return A.precision_recall_f1(tiers(spark, sf_dir), [
        "stat_is_anomaly", "ml_is_anomaly", "dl_is_anomaly", "ensemble_is_anomaly"])


@query("gbt_forecast")
def gbt_forecast(spark, sf_dir):
    """Recursive 90-day boosted-tree forecast per stream."""
    return M.gbt_forecast(_series(spark, sf_dir))


@query("additive_forecast")
def additive_forecast(spark, sf_dir):
    """I8: additive trend + weekly forecast, history and 90 days, 90 % band."""
    return M.additive_forecast(_series(spark, sf_dir))


@query("backtest_route")
def backtest_route(spark, sf_dir):
    """30-day hold-out WMAPE of both models and the routing decision."""
    return M.backtest_route(_series(spark, sf_dir))


@query("production_forecast")
def production_forecast(spark, sf_dir):
    """90-day forecast of the routed model per stream, clamped bands."""
    return M.production_forecast(_series(spark, sf_dir))
