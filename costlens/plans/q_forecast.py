"""Queries: daily-series windows and window-only forecasting (F4-F7, C8,
C9, E7, E8, I9, I10/I11 exact, D2, D3, D5, B13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens import fixed
from costlens.operators import aggregates as A
from costlens.operators import forecast_window as FW
from costlens.operators import windows as W
from costlens.plans import sqlparts as Q
from costlens.plans.catalog import query
from costlens.sources import tables as T

SER = Q.series_ctes()


def _series(spark, sf_dir):
    return FW.cleaned_series(T.spend(T.Tables(spark, sf_dir), team=False))


@query("centered_median_7", Q.with_(*SER, final="""SELECT cloud_provider, unified_category, date,
  cost, had_anomaly, rolling_median FROM series"""))
def centered_median_7(spark, sf_dir):
    """median of the 7 days centred on each day (edges: what exists)."""
    return _series(spark, sf_dir).select("cloud_provider", "unified_category", "date", "cost",
                                         "had_anomaly", "rolling_median")


@query("clean_anomalies", Q.with_(*SER, final="SELECT * FROM series"))
def clean_anomalies(spark, sf_dir):
    """cleaned cost = centred median on labelled days, else the cost."""
    return _series(spark, sf_dir)


LAGS_SQL = """SELECT cloud_provider, unified_category, date, cleaned_cost,
  LAG(cleaned_cost, 1) OVER w AS lag_1, LAG(cleaned_cost, 7) OVER w AS lag_7,
  LAG(cleaned_cost, 14) OVER w AS lag_14,
  CASE WHEN COUNT(y) OVER w7 = 7 THEN CAST(SUM(y) OVER w7 AS DOUBLE) / 700 END AS rolling_mean_7,
  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week
FROM series WINDOW w AS (PARTITION BY cloud_provider, unified_category ORDER BY date),
  w7 AS (PARTITION BY cloud_provider, unified_category ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""


def _lag_frame(spark, sf_dir):
    s = _series(spark, sf_dir)
    s = W.lags(s, "cleaned_cost")
    s = W.rolling_mean_strict(s, "y")
    from costlens.functions import columns as C
    return s.select("cloud_provider", "unified_category", "date", "cleaned_cost", "lag_1", "lag_7",
                    "lag_14", "rolling_mean_7", C.day_of_week("date").alias("day_of_week"))


@query("lag_1_7_14", Q.with_(*SER, ("lf", LAGS_SQL), final="""SELECT cloud_provider, unified_category,
  date, cleaned_cost, lag_1, lag_7, lag_14 FROM lf"""))
def lag_1_7_14(spark, sf_dir):
    """cleaned cost 1, 7 and 14 rows back."""
    return _lag_frame(spark, sf_dir).drop("rolling_mean_7", "day_of_week")


@query("rolling_mean_7_strict", Q.with_(*SER, ("lf", LAGS_SQL), final="""SELECT cloud_provider,
  unified_category, date, cleaned_cost, rolling_mean_7 FROM lf"""))
def rolling_mean_7_strict(spark, sf_dir):
    """mean of the 7 previous cleaned values, null unless all 7 exist."""
    return _lag_frame(spark, sf_dir).select("cloud_provider", "unified_category", "date",
                                            "cleaned_cost", "rolling_mean_7")


@query("drop_incomplete", Q.with_(*SER, ("lf", LAGS_SQL), final="""SELECT * EXCLUDE (lag_14) FROM lf
WHERE lag_1 IS NOT NULL AND lag_7 IS NOT NULL AND rolling_mean_7 IS NOT NULL"""))
def drop_incomplete(spark, sf_dir):
    """Training rows of the boosted-tree features (lag warm-up dropped)."""
    return _lag_frame(spark, sf_dir).drop("lag_14").na.drop(subset=["lag_1", "lag_7", "rolling_mean_7"])


@query("tail_split", Q.with_(*SER, *Q.route()[:1], final="""SELECT cloud_provider, unified_category,
  date, y, pos, is_validation FROM rt_sp"""))
def tail_split(spark, sf_dir):
    """The last 30 days of each stream are the validation slice."""
    return FW.tail_split(_series(spark, sf_dir)).select(
        "cloud_provider", "unified_category", "date", "y", "pos", "is_validation")


@query("trend_weekday_forecast", Q.with_(*SER, *Q.tw_forecast("series", "tw_"),
                                         final="SELECT * FROM tw_fc"))
def trend_weekday_forecast(spark, sf_dir):
    """Linear trend + weekday effect, 90 days ahead with a 90 % band."""
    return FW.trend_weekday_forecast(_series(spark, sf_dir))


@query("clamp_nonneg", Q.with_(*SER, *Q.tw_fit("series", "tw_"), ("fut", Q.future("tw_", 90)),
                               ("p", Q.tw_pred("fut", "tw_")), final="""SELECT cloud_provider,
  unified_category, date, (pred_cents - 1.645 * sigma_cents) / 100 AS raw_lower,
  GREATEST(0.0, (pred_cents - 1.645 * sigma_cents) / 100) AS lower_bound FROM p"""))
def clamp_nonneg(spark, sf_dir):
    """The forecast's lower band before and after clamping at 0."""
    from costlens.functions import columns as C
    s = _series(spark, sf_dir)
    fit = FW.trend_weekday_fit(s)
    p = FW.trend_weekday_predict(fit, FW.future_dates(fit), )
    raw = (F.col("pred_cents") - F.lit(fixed.INTERVAL_Z) * F.col("sigma_cents")) / 100
    return p.select("cloud_provider", "unified_category", "date", raw.alias("raw_lower"),
                    C.clamp_nonneg(raw).alias("lower_bound"))


@query("backtest_route_exact", Q.with_(*SER, *Q.route(), final="SELECT * FROM route"))
def backtest_route_exact(spark, sf_dir):
    """I10 (exact): 30-day hold-out, trend+weekday vs seasonal naive, WMAPE,
    trend chosen only when strictly better."""
    return FW.backtest_route_exact(_series(spark, sf_dir))


@query("production_forecast_exact", Q.with_(*SER, *Q.production(), final="SELECT * FROM production"))
def production_forecast_exact(spark, sf_dir):
    """I11 (exact): 90-day forecast of the routed model for every stream."""
    return FW.production_forecast_exact(_series(spark, sf_dir))


WMAPE_SQL = Q.with_(*SER, *Q.route(), final="""SELECT cloud_provider, unified_category,
  CAST(SUM(ABS(CAST(ROUND(y / 100.0 * 100) AS BIGINT) - CAST(ROUND(naive_cents / 100.0 * 100) AS BIGINT))) AS BIGINT)
    AS abs_error_cents,
  CAST(SUM(ABS(CAST(ROUND(y / 100.0 * 100) AS BIGINT))) AS BIGINT) AS abs_actual_cents,
  CASE WHEN SUM(ABS(CAST(ROUND(y / 100.0 * 100) AS BIGINT))) = 0 THEN 0.0
       ELSE CAST(SUM(ABS(CAST(ROUND(y / 100.0 * 100) AS BIGINT) - CAST(ROUND(naive_cents / 100.0 * 100) AS BIGINT))) AS DOUBLE)
            / CAST(SUM(ABS(CAST(ROUND(y / 100.0 * 100) AS BIGINT))) AS BIGINT) END AS wmape
FROM rt_both GROUP BY ALL""")


def _val_pairs(spark, sf_dir):
    """Validation rows with actual and naive prediction, in money."""
    s = _series(spark, sf_dir)
    sp = FW.tail_split(s)
    train = sp.where("is_validation = 0")
    nt = train.groupBy("cloud_provider", "unified_category").agg(F.count(F.lit(1)).alias("_nt"))
    val = sp.where("is_validation = 1").join(nt, ["cloud_provider", "unified_category"]) \
            .withColumn("h", F.col("pos") - F.col("_nt") + 1)
    p = FW.naive_predict(FW.naive_fit(train), val.select("cloud_provider", "unified_category",
                                                         "date", "h", "y"))
    return p.select("cloud_provider", "unified_category", "date", (F.col("y") / 100).alias("actual"),
                    (F.col("pred_cents") / 100).alias("pred"))


@query("wmape", WMAPE_SQL)
def wmape(spark, sf_dir):
    """WMAPE of the seasonal-naive backtest per stream."""
    return A.wmape(_val_pairs(spark, sf_dir), "actual", "pred", ["cloud_provider", "unified_category"])


@query("residual_std", Q.with_(*SER, *Q.tw_fit("series", "tw_"), ("lagged", """SELECT cloud_provider, unified_category,
  y - LAG(y, 7) OVER (PARTITION BY cloud_provider, unified_category ORDER BY date) AS _r FROM series"""),
    ("nv", """SELECT cloud_provider, unified_category, COUNT(*) AS n_naive, SQRT(""" + Q.d2d(
        """CAST(COUNT(*) AS DECIMAL(38,0)) * SUM(CAST(_r AS DECIMAL(38,0)) * CAST(_r AS DECIMAL(38,0)))
       - CAST(SUM(_r) AS DECIMAL(38,0)) * CAST(SUM(_r) AS DECIMAL(38,0))""") + """ / (COUNT(*) * COUNT(*) * 10000))
    AS std_naive FROM lagged WHERE _r IS NOT NULL GROUP BY ALL"""),
    final="""SELECT f.cloud_provider, f.unified_category, f.n AS n_trend, g.sigma_cents / 100 AS std_trend, n_naive, std_naive
FROM tw_fit f JOIN tw_sig g USING (cloud_provider, unified_category) LEFT JOIN nv USING (cloud_provider, unified_category)"""))
def residual_std(spark, sf_dir):
    """Population std of both models' residuals on their training rows."""
    return FW.train_residual_std(_series(spark, sf_dir))


@query("backtest_residual_std", Q.with_(*SER, *Q.route(), final="""SELECT cloud_provider, unified_category,
  COUNT(*) AS n, SQRT(""" + Q.d2d("""CAST(COUNT(*) AS DECIMAL(38,0)) * SUM(CAST(_r AS DECIMAL(38,0)) * CAST(_r AS DECIMAL(38,0)))
       - CAST(SUM(_r) AS DECIMAL(38,0)) * CAST(SUM(_r) AS DECIMAL(38,0))""") + """ / (COUNT(*) * COUNT(*) * 10000))
    AS residual_std
FROM (SELECT *, CAST(ROUND(y / 100.0 * 100) AS BIGINT) - CAST(ROUND(naive_cents / 100.0 * 100) AS BIGINT) AS _r
      FROM rt_both) GROUP BY ALL"""))
def backtest_residual_std(spark, sf_dir):
    """Population std of the held-out residuals per stream."""
    return A.residual_std(_val_pairs(spark, sf_dir), "actual", "pred",
                          ["cloud_provider", "unified_category"])


CMP = [*Q.tw_fit("series", "tw_"), ("fut", Q.future("tw_", 90)),
       ("dates", "SELECT cloud_provider, unified_category, 0 AS h, date FROM series UNION ALL SELECT * FROM fut"),
       ("a", f"""SELECT cloud_provider, unified_category, date,
  GREATEST(0.0, CAST(pred_cents AS DOUBLE) / 100) AS trend_forecast,
  GREATEST(0.0, (pred_cents - 1.645 * sigma_cents) / 100) AS trend_lower,
  GREATEST(0.0, (pred_cents + 1.645 * sigma_cents) / 100) AS trend_upper FROM ({Q.tw_pred('dates', 'tw_')})"""),
       *Q.naive_forecast("series", "nv_"),
       ("cmp", """SELECT a.*, b.predicted_cost AS naive_forecast FROM a LEFT JOIN nv_fc b
  USING (cloud_provider, unified_category, date)""")]


@query("forecast_compare", Q.with_(*SER, *CMP, final="SELECT * FROM cmp"))
def forecast_compare(spark, sf_dir):
    """Trend model (history + future) left-joined with the naive future."""
    return FW.forecast_compare(_series(spark, sf_dir))


@query("horizon_lookup", Q.with_(*SER, *CMP, final="""SELECT t.cloud_provider, t.unified_category,
  t.horizon, t.date, c.trend_forecast, c.trend_lower, c.trend_upper, c.naive_forecast
FROM (SELECT cloud_provider, unified_category, horizon, CAST(last_date + horizon AS DATE) AS date
      FROM (SELECT cloud_provider, unified_category, MAX(date) AS last_date FROM series GROUP BY ALL),
           (SELECT CAST(unnest([7, 30, 90]) AS INTEGER) AS horizon)) t
LEFT JOIN cmp c USING (cloud_provider, unified_category, date)"""))
def horizon_lookup(spark, sf_dir):
    """D3: compared forecasts at last date + 7, 30 and 90 days."""
    return FW.horizon_lookup(_series(spark, sf_dir))


def _panel_sql() -> str:
    mults = ", ".join(f"('{p}', '{c}', {float(m)})" for p, cs in fixed.BAND_MULTIPLIERS.items()
                      for c, m in cs.items())
    return Q.with_(
        ("spend", Q.spend(team=False)),
        ("d", Q.daily_flag(keys="series")),
        ("series", Q.cleaned(keys="series")),
        *Q.tw_forecast("series", "tw_", keys="series"),
        ("m", f"SELECT * FROM (VALUES {mults}) v(cloud_provider, unified_category, _m)"),
        final="""SELECT date, cloud_provider, unified_category,
  ROUND(predicted_cost * _m * 100) / 100 AS predicted_cost,
  ROUND(predicted_cost * _m * 0.85 * 100) / 100 AS lower_bound,
  ROUND(predicted_cost * _m * 1.15 * 100) / 100 AS upper_bound, 'Ensemble ML' AS model_used
FROM tw_fc, m""").replace("FROM spend GROUP BY ALL", "FROM (SELECT 'total' AS series, * FROM spend) GROUP BY ALL")


@query("forecast_band_panel", _panel_sql())
def forecast_band_panel(spark, sf_dir):
    """The total-spend trend forecast as base curve, spread over the
    nine provider/category streams with fixed multipliers and 0.85/1.15
    bands."""
    sp = T.spend(T.Tables(spark, sf_dir), team=False).withColumn("series", F.lit("total"))
    base = FW.trend_weekday_forecast(FW.cleaned_series(sp, ["series"]), keys=["series"])
    return FW.band_panel(base.select("date", F.col("predicted_cost").alias("base_cost")))
