"""Queries: daily aggregation and the statistical tier."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.operators import aggregates as A
from costlens.operators import detect as D
from costlens.plans import sqlparts as Q
from costlens.plans.catalog import query
from costlens.sources.tables import Tables, spend


def _stream_spend(spark, sf_dir):
    return spend(Tables(spark, sf_dir), team=False)


@query("daily_cost", Q.with_(("spend", Q.spend(team=False)), ("daily", Q.daily()),
                             final="SELECT * FROM daily"))
def daily_cost(spark, sf_dir):
    """Sum of cost per stream and day."""
    return A.daily_cost(_stream_spend(spark, sf_dir))


@query("daily_cost_flag", Q.with_(("spend", Q.spend(team=False)), ("d", Q.daily_flag()),
                                  final="SELECT * FROM d"))
def daily_cost_flag(spark, sf_dir):
    """Cost and any-label flag per stream and day."""
    return A.daily_cost_flag(_stream_spend(spark, sf_dir))


@query("seasonal_residual", Q.with_(("spend", Q.spend(team=False)), ("daily", Q.daily()),
                                    ("resid", Q.seasonal()), final="SELECT * FROM resid"))
def seasonal_residual(spark, sf_dir):
    """Window-only seasonal decomposition of each stream's daily cost."""
    return D.seasonal_residual(A.daily_cost(_stream_spend(spark, sf_dir)))


@query("rolling_z_14", Q.with_(*Q.scored_days(), final="SELECT * FROM scores"))
def rolling_z_14(spark, sf_dir):
    """14-day rolling z of the seasonal residual, with its flag."""
    return D.day_scores(_stream_spend(spark, sf_dir))


@query("broadcast_day_score", Q.with_(*Q.scored_days(), final=Q.stat_rows()))
def broadcast_day_score(spark, sf_dir):
    """Every spend row carries its stream-day's z and flag."""
    sp = _stream_spend(spark, sf_dir)
    return D.broadcast_day_score(sp, D.day_scores(sp))


@query("stat_detector", Q.with_(*Q.scored_days(), ("rows", Q.spend(team=True)),
                               final=Q.stat_rows("rows")))
def stat_detector(spark, sf_dir):
    """I3 (window version): spend rows scored by the statistical tier.

    The spend view has one row per line item (the team lookup joins are
    key lookups), so the day scores are computed from the lean view without
    those joins; only the scored rows carry the team."""
    t = Tables(spark, sf_dir)
    return D.broadcast_day_score(spend(t, team=True), D.day_scores(spend(t, team=False)))


def flagship(spark, sf_dir):
    """All scored stream-days (E1 -> I2 -> F3 -> flag)."""
    return D.day_scores(_stream_spend(spark, sf_dir)).orderBy(
        "cloud_provider", "unified_category", "date")
