"""Window- and aggregate-only forecasting (I9, the exact I10/I11 route,
D2, D3, D5, C8, C9).

All of it runs on the daily series (one row per stream and day), whose
length is bounded by the calendar; fits are single-pass aggregates with
integer (cents) sums, so a fit is exact and order-independent:

* ``trend_weekday``: least-squares line on the day number plus the mean
  weekday residual; band = +-1.645 x population std of the residual.
* ``seasonal_naive``: each future day repeats the value of the same slot in
  the last observed week (a lag-7 recursion); band from the in-sample
  lag-7 residual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens import fixed
from costlens.functions import columns as C
from costlens.operators import aggregates as A
from costlens.operators import windows as W
from costlens.operators.keyed import join_groups
from costlens.schema import S
from costlens.session import materialize

TREND = "trend_weekday"
NAIVE = "seasonal_naive"

D38 = "decimal(38,0)"


def _d(c: str | Column) -> Column:
    return C.col_(c).cast(D38)


def epoch_day(c: str | Column) -> Column:
    return F.unix_date(C.col_(c)).cast("long")


def cleaned_series(spend: DataFrame, keys: Sequence[str] = S) -> DataFrame:
    """E2 -> F4 -> F5: daily cost, flag, centred median, cleaned cost and
    cleaned cents (``y``) per stream."""
    d = W.clean_anomalies(A.daily_cost_flag(spend, keys), keys)
    # The series (streams x days, bounded by the calendar) feeds every fit,
    # split and forecast below: materialise it once in the checkpoint folder
    # instead of re-aggregating the raw spend in each branch.
    return materialize(d.withColumn("y", C.cents("cleaned_cost")), "daily-series")


def tail_split(series: DataFrame, n_tail: int = fixed.VALIDATION_DAYS,
               keys: Sequence[str] = S) -> DataFrame:
    """``pos`` (0-based, by date) and ``is_validation`` = last n rows."""
    w = Window.partitionBy(*keys).orderBy("date")
    wd = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    return (series.withColumn("pos", F.row_number().over(w) - 1)
                  .withColumn("is_validation", (F.row_number().over(wd) <= n_tail).cast("int")))


# --- trend + weekday -------------------------------------------------------
def trend_weekday_fit(train: DataFrame, keys: Sequence[str] = S, y: str = "y") -> DataFrame:
    """One row per stream: slope, intercept, weekday effects, sigma, dates.

    One shuffle: every step is a window over ``partitionBy(stream)`` or
    ``partitionBy(stream, weekday)`` (both satisfied by hashing on the
    stream) and the final ``groupBy(stream)`` reuses that partitioning.
    All sums are exact integer sums; each double comes from one division."""
    w = Window.partitionBy(*keys)
    x = epoch_day("date")
    t = train.select(*keys, "date", F.col(y).alias("_y"), x.alias("_x"),
                     C.day_of_week("date").alias("_dow"))
    n = F.count(F.lit(1)).over(w)
    sx, sy = F.sum("_x").over(w), F.sum("_y").over(w)
    sxx = F.sum(_d("_x") * _d("_x")).over(w)
    sxy = F.sum(_d("_x") * _d("_y")).over(w)
    t = t.select("*", n.alias("n"), sx.alias("sx"), sy.alias("sy"), sxx.alias("sxx"), sxy.alias("sxy"))
    den = _d("n") * F.col("sxx") - _d("sx") * _d("sx")
    num_b = _d("n") * F.col("sxy") - _d("sx") * _d("sy")
    num_a = _d("sy") * F.col("sxx") - _d("sx") * F.col("sxy")
    t = t.select(*keys, "date", "_y", "_x", "_dow", "n",
                 F.when(den == 0, F.lit(0.0)).otherwise(C.dec_to_double(num_b) / C.dec_to_double(den))
                 .alias("slope"),
                 F.when(den == 0, F.col("sy").cast("double") / F.col("n"))
                 .otherwise(C.dec_to_double(num_a) / C.dec_to_double(den)).alias("intercept"))
    # weekday effect of the residual, then sigma of what remains
    t = t.withColumn("_r", F.col("_y") - F.round(F.col("intercept") + F.col("slope") * F.col("_x")).cast("long"))
    wd = Window.partitionBy(*keys, "_dow")
    t = t.withColumn("_eff", F.round(F.sum("_r").over(wd).cast("double") / F.count(F.lit(1)).over(wd))
                     .cast("long"))
    t = t.withColumn("_r2", F.col("_r") - F.col("_eff"))
    g = t.groupBy(*keys).agg(
        F.first("n").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.first("slope").alias("slope"), F.first("intercept").alias("intercept"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("_dow", "_eff")))).alias("weekday_effect"),
        F.count(F.lit(1)).alias("_n"), F.sum("_r2").alias("_s"), F.sum(_d("_r2") * _d("_r2")).alias("_q"))
    num = _d("_n") * F.col("_q") - _d("_s") * _d("_s")
    return g.select(*keys, "n", "first_date", "last_date", "slope", "intercept", "weekday_effect",
                    F.sqrt(C.dec_to_double(num) / (F.col("_n") * F.col("_n")).cast("double"))
                    .alias("sigma_cents"))


def trend_weekday_predict(fit: DataFrame, dates: DataFrame, keys: Sequence[str] = S) -> DataFrame:
    """Predicted cents at each (stream, date) of ``dates``."""
    j = join_groups(dates, fit.select(*keys, "slope", "intercept", "weekday_effect", "sigma_cents"), keys)
    fitted = F.round(F.col("intercept") + F.col("slope") * epoch_day("date")).cast("long")
    eff = F.coalesce(F.element_at("weekday_effect", C.day_of_week("date")), F.lit(0).cast("long"))
    return j.withColumn("pred_cents", fitted + eff).drop("slope", "intercept", "weekday_effect")


def future_dates(fit: DataFrame, horizon: int = fixed.HORIZON_DAYS,
                 keys: Sequence[str] = S) -> DataFrame:
    """``horizon`` days after each stream's last date (explode: no join)."""
    return fit.select(*keys, "last_date", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")) \
              .select(*keys, "h", F.date_add("last_date", F.col("h")).alias("date"))


def band(pred_cents: Column, sigma_cents: Column, model: str) -> list[Column]:
    """predicted / lower / upper in money, clamped at 0."""
    z = F.lit(fixed.INTERVAL_Z)
    return [C.clamp_nonneg(pred_cents.cast("double") / 100).alias("predicted_cost"),
            C.clamp_nonneg((pred_cents - z * sigma_cents) / 100).alias("lower_bound"),
            C.clamp_nonneg((pred_cents + z * sigma_cents) / 100).alias("upper_bound"),
            F.lit(model).alias("model_used")]


def trend_weekday_forecast(series: DataFrame, horizon: int = fixed.HORIZON_DAYS,
                           keys: Sequence[str] = S) -> DataFrame:
    """Fit on the whole series, project ``horizon`` days."""
    fit = trend_weekday_fit(series, keys)
    p = trend_weekday_predict(fit, future_dates(fit, horizon, keys), keys)
    return p.select(*keys, "date", *band(F.col("pred_cents"), F.col("sigma_cents"), TREND))


# --- seasonal naive --------------------------------------------------------
def naive_fit(series: DataFrame, keys: Sequence[str] = S, y: str = "y",
              season: int = 7) -> DataFrame:
    """Last ``season`` values (as a map slot -> cents), their count and the
    in-sample lag-``season`` residual sigma."""
    w = Window.partitionBy(*keys).orderBy("date")
    wd = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    s = series.select(*keys, "date", F.col(y).alias("_y"),
                      (F.col(y) - F.lag(y, season).over(w)).alias("_r"),
                      (F.row_number().over(wd) - 1).alias("_back"))
    g = s.groupBy(*keys).agg(
        F.max("date").alias("last_date"),
        F.map_from_entries(F.collect_list(F.when(F.col("_back") < season, F.struct(
            (season - 1 - F.col("_back")).alias("slot"), F.col("_y"))))).alias("last_season"),
        F.count("_r").alias("_n"), F.sum("_r").alias("_s"), F.sum(_d("_r") * _d("_r")).alias("_q"))
    num = _d("_n") * F.col("_q") - _d("_s") * _d("_s")
    return g.select(*keys, "last_date", "last_season",
                    F.when(F.col("_n") > 0, F.sqrt(C.dec_to_double(num)
                                                   / (F.col("_n") * F.col("_n")).cast("double")))
                    .alias("sigma_cents"))


def naive_predict(fit: DataFrame, steps: DataFrame, keys: Sequence[str] = S,
                  season: int = 7) -> DataFrame:
    """``steps`` carries keys and ``h`` (1 = first day after the fit's last
    row); the prediction is the value of slot (h - 1) mod season."""
    j = join_groups(steps, fit.select(*keys, "last_season", "sigma_cents"), keys)
    slot = F.pmod(F.col("h") - 1, F.lit(season))
    return j.withColumn("pred_cents", F.element_at("last_season", slot)).drop("last_season")


def naive_forecast(series: DataFrame, horizon: int = fixed.HORIZON_DAYS,
                   keys: Sequence[str] = S) -> DataFrame:
    fit = naive_fit(series, keys)
    p = naive_predict(fit, future_dates(fit, horizon, keys), keys)
    return p.select(*keys, "date", *band(F.col("pred_cents"), F.col("sigma_cents"), NAIVE))


# --- exact route (I10) and production forecast (I11) -------------------------
def backtest_route_exact(series: DataFrame, n_val: int = fixed.VALIDATION_DAYS,
                         keys: Sequence[str] = S) -> DataFrame:
    """Hold out the last ``n_val`` rows per stream, forecast them with both
    models, WMAPE each; pick the trend model only when strictly better."""
    # both models and the errors start from the split: cut it once
    sp = materialize(tail_split(series, n_val, keys), "backtest-split")
    train = sp.where(F.col("is_validation") == 0)
    val = sp.where(F.col("is_validation") == 1)
    n_train = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nt"))
    val = join_groups(val, n_train, keys).withColumn("h", F.col("pos") - F.col("_nt") + 1)
    tr = trend_weekday_predict(trend_weekday_fit(train, keys), val.select(*keys, "date", "h", "y"),
                               keys).withColumnRenamed("pred_cents", "trend_cents")
    nv = naive_predict(naive_fit(train, keys), val.select(*keys, "date", "h"), keys) \
        .select(*keys, "date", F.col("pred_cents").alias("naive_cents"))
    j = join_groups(tr, nv, [*keys, "date"])
    err = j.groupBy(*keys).agg(
        F.sum(F.abs(F.col("y") - F.col("trend_cents"))).alias("trend_err"),
        F.sum(F.abs(F.col("y") - F.col("naive_cents"))).alias("naive_err"),
        F.sum(F.abs("y")).alias("actual_abs"))

    def wm(e: str) -> Column:
        return F.when(F.col("actual_abs") == 0, F.lit(0.0)).otherwise(
            F.col(e).cast("double") / F.col("actual_abs"))

    return err.select(*keys, wm("trend_err").alias("wmape_trend"), wm("naive_err").alias("wmape_naive"),
                      F.when(wm("trend_err") < wm("naive_err"), F.lit(TREND)).otherwise(F.lit(NAIVE))
                      .alias("model_used"))


def production_forecast_exact(series: DataFrame, horizon: int = fixed.HORIZON_DAYS,
                              keys: Sequence[str] = S) -> DataFrame:
    """The routed model's ``horizon``-day forecast for every stream."""
    route = materialize(backtest_route_exact(series, keys=keys).select(*keys, F.col("model_used").alias("_m")), "route")
    routed = join_groups(series, route, keys)
    # a stream is fitted by its own model only
    trend = trend_weekday_forecast(routed.where(F.col("_m") == TREND).drop("_m"), horizon, keys)
    return trend.unionByName(naive_forecast(routed.where(F.col("_m") == NAIVE).drop("_m"), horizon, keys))


def train_residual_std(series: DataFrame, keys: Sequence[str] = S, season: int = 7) -> DataFrame:
    """Population std of what the routed pair's models leave of their own
    training rows: the trend model over all rows, the seasonal one over rows that
    have a row ``season`` rows before them."""
    trend = trend_weekday_fit(series, keys).select(*keys, F.col("n").alias("n_trend"), (F.col("sigma_cents") / 100).alias("std_trend"))
    w = Window.partitionBy(*keys).orderBy("date")
    r = series.select(*keys, ((F.col("y") - F.lag("y", season).over(w)) / 100).alias("_r"))
    naive = A.residual_std(r.where("_r IS NOT NULL").withColumn("_zero", F.lit(0.0)), "_r", "_zero", keys)
    return join_groups(trend, naive.select(*keys, F.col("n").alias("n_naive"), F.col("residual_std").alias("std_naive")), keys, "left")


# --- D2 / D3 / D5 ------------------------------------------------------------
def forecast_compare(series: DataFrame, horizon: int = fixed.HORIZON_DAYS,
                     keys: Sequence[str] = S) -> DataFrame:
    """Trend model over history + future, left-joined with the naive
    model's future on (stream, date)."""
    fit = trend_weekday_fit(series, keys)
    hist = series.select(*keys, "date", F.lit(0).alias("h"))
    dates = hist.unionByName(future_dates(fit, horizon, keys))
    a = trend_weekday_predict(fit, dates, keys).select(
        *keys, "date", *[c.alias(f"trend_{n}") for c, n in zip(
            band(F.col("pred_cents"), F.col("sigma_cents"), TREND)[:3],
            ("forecast", "lower", "upper"))])
    b = naive_forecast(series, horizon, keys).select(*keys, "date",
                                                     F.col("predicted_cost").alias("naive_forecast"))
    return join_groups(a, b, [*keys, "date"], "left")


def horizon_lookup(series: DataFrame, lookaheads: Sequence[int] = tuple(fixed.LOOKAHEADS),
                   keys: Sequence[str] = S) -> DataFrame:
    """D3: the compared forecasts at last date + 7, 30, 90."""
    cmp_ = forecast_compare(series, max(lookaheads), keys)
    last = series.groupBy(*keys).agg(F.max("date").alias("_last"))
    targets = last.select(*keys, F.explode(F.array(*[F.lit(k) for k in lookaheads])).alias("horizon"),
                          "_last").withColumn("date", F.date_add("_last", F.col("horizon"))).drop("_last")
    return join_groups(targets, cmp_, [*keys, "date"], "left")


def band_panel(base: DataFrame, multipliers: dict = fixed.BAND_MULTIPLIERS,
               model: str = fixed.BAND_MODEL) -> DataFrame:
    """Each base-curve day x each stream's multiplier, with 0.85 / 1.15
    bands rounded to cents. ``base`` has (date, base_cost)."""
    entries = [F.struct(F.lit(p).alias("cloud_provider"), F.lit(c).alias("unified_category"),
                        F.lit(float(m)).alias("_m"))
               for p, cats in multipliers.items() for c, m in cats.items()]
    x = base.select("date", "base_cost", F.explode(F.array(*entries)).alias("_s"))
    bc = F.col("base_cost") * F.col("_s._m")
    return x.select("date", "_s.cloud_provider", "_s.unified_category",
                    C.round_money(bc).alias("predicted_cost"),
                    C.round_money(bc * fixed.BAND_LOW).alias("lower_bound"),
                    C.round_money(bc * fixed.BAND_HIGH).alias("upper_bound"),
                    F.lit(model).alias("model_used"))
