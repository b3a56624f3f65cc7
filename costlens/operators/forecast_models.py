"""Model forecasters on the cleaned daily series.

Each stream's cleaned daily series is aggregated by Spark (E2 -> F4 -> F5),
so a group is one stream's days: bounded by the calendar, independent of
the data volume. The models fit and recurse inside
``groupBy(stream).applyInPandas`` - all streams in parallel, no per-step
Spark jobs, no frame concatenation per step (a preallocated buffer holds
the recursion).

* boosted trees: gradient boosting of depth-5 regression trees (50 rounds,
  learning rate 0.05, at least 20 rows per leaf) on lag features; the
  multi-step forecast is recursive, each prediction feeding the next lags.
* additive: piecewise-linear trend (25 changepoints over the first 80 % of
  the history, ridge-shrunk with the changepoint prior) plus a weekly
  Fourier seasonality of order 3, fit by least squares (the model form of
  Taylor & Letham, 2018); the 90 % band is +-1.645 x residual std.

These are re-implementations of the model forms, not the libraries the
reference calls; numbers are close in spirit, not bit-equal.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from costlens import fixed
from costlens.schema import S

# --- boosted regression trees ------------------------------------------------


def _best_split(X: np.ndarray, r: np.ndarray, min_leaf: int):
    n = len(r)
    best = (0.0, -1, 0.0)
    total = r.sum()
    for f in range(X.shape[1]):
        order = np.argsort(X[:, f], kind="stable")
        xs, rs = X[order, f], r[order]
        cs = np.cumsum(rs)[:-1]
        nl = np.arange(1, n)
        ok = (nl >= min_leaf) & (n - nl >= min_leaf) & (xs[1:] > xs[:-1])
        if not ok.any():
            continue
        gain = cs ** 2 / nl + (total - cs) ** 2 / (n - nl) - total ** 2 / n
        gain = np.where(ok, gain, -np.inf)
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), f, float((xs[i] + xs[i + 1]) / 2))
    return best


def _grow(X, r, depth, max_depth, min_leaf, nodes):
    idx = len(nodes)
    nodes.append([-1, 0.0, -1, -1, float(r.mean()) if len(r) else 0.0])
    if depth >= max_depth or len(r) < 2 * min_leaf:
        return idx
    gain, f, t = _best_split(X, r, min_leaf)
    if f < 0:
        return idx
    m = X[:, f] <= t
    nodes[idx][0], nodes[idx][1] = f, t
    nodes[idx][2] = _grow(X[m], r[m], depth + 1, max_depth, min_leaf, nodes)
    nodes[idx][3] = _grow(X[~m], r[~m], depth + 1, max_depth, min_leaf, nodes)
    return idx


def _as_arrays(nodes):
    a = np.array(nodes, dtype=float)
    return (a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4])


def _tree_predict(tree, X):
    """Vectorised walk: one numpy step per tree level for all rows."""
    feat, thr, left, right, val = tree
    node = np.zeros(len(X), dtype=np.int64)
    rows = np.arange(len(X))
    for _ in range(64):
        f = feat[node]
        internal = f >= 0
        if not internal.any():
            break
        x = X[rows, np.maximum(f, 0)]
        node = np.where(internal, np.where(x <= thr[node], left[node], right[node]), node)
    return val[node]


class BoostedTrees:
    def __init__(self, rounds=fixed.GBT_ROUNDS, depth=fixed.GBT_DEPTH, lr=fixed.GBT_LEARNING_RATE,
                 min_leaf=20):
        self.rounds, self.depth, self.lr, self.min_leaf = rounds, depth, lr, min_leaf

    def fit(self, X, y):
        self.base = float(np.mean(y)) if len(y) else 0.0
        pred = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            nodes = []
            _grow(X, y - pred, 0, self.depth, self.min_leaf, nodes)
            tree = _as_arrays(nodes)
            self.trees.append(tree)
            pred += self.lr * _tree_predict(tree, X)
        return self

    def predict(self, X):
        p = np.full(len(X), self.base)
        for tree in self.trees:
            p += self.lr * _tree_predict(tree, X)
        return p


def _lag_matrix(y: np.ndarray, dates: pd.Series, lags=(1, 7), roll=7) -> tuple[np.ndarray, np.ndarray]:
    """Rows with every lag available (warm-up dropped, C8)."""
    n, start = len(y), max(max(lags), roll)
    if n <= start:
        return np.empty((0, len(lags) + 2)), np.empty(0)
    dow = pd.to_datetime(dates).dt.dayofweek.to_numpy(dtype=float)
    c = np.concatenate([[0.0], np.cumsum(y)])
    idx = np.arange(start, n)
    cols = [y[idx - k] for k in lags] + [(c[idx] - c[idx - roll]) / roll, dow[idx]]
    return np.column_stack(cols), y[idx]


def _recurse(model, history: np.ndarray, next_dates, lags=(1, 7), roll=7) -> np.ndarray:
    buf = np.empty(len(history) + len(next_dates))
    buf[:len(history)] = history
    n = len(history)
    out = np.empty(len(next_dates))
    for s, d in enumerate(next_dates):
        feats = [buf[n - k] if n >= k else buf[n - 1] for k in lags]
        feats += [buf[max(0, n - roll):n].mean(), pd.Timestamp(d).dayofweek]
        p = float(model.predict(np.array([feats], dtype=float))[0])
        out[s] = p
        buf[n] = p
        n += 1
    return out


def gbt_fit_forecast(y, dates, next_dates, lags=(1, 7)):
    X, t = _lag_matrix(y, dates, lags)
    m = BoostedTrees().fit(X, t)
    resid_std = float(np.std(t - m.predict(X))) if len(t) else 0.0
    return _recurse(m, y, next_dates, lags), resid_std


# --- additive trend + weekly seasonality ---------------------------------------


def _design(days: np.ndarray, t0: float, span: float, cps: np.ndarray, order: int = 3) -> np.ndarray:
    t = (days - t0) / span
    cols = [np.ones_like(t), t] + [np.maximum(0.0, t - c) for c in cps]
    for k in range(1, order + 1):
        ang = 2 * np.pi * k * days / 7.0
        cols += [np.sin(ang), np.cos(ang)]
    return np.column_stack(cols)


def additive_fit_predict(y: np.ndarray, days: np.ndarray, at_days: np.ndarray,
                         n_cp: int = 25, cp_range: float = 0.8,
                         prior: float = fixed.CHANGEPOINT_PRIOR) -> tuple[np.ndarray, float]:
    """Fit on (days, y); return predictions at ``at_days`` and the residual std."""
    n = len(y)
    scale = float(np.max(np.abs(y))) or 1.0
    ys = y / scale
    t0, span = float(days[0]), float(max(days[-1] - days[0], 1))
    hist = max(int(np.floor(n * cp_range)), 1)
    cp_idx = np.unique(np.linspace(0, hist - 1, n_cp + 1).round().astype(int))[1:]
    cps = (days[cp_idx] - t0) / span if n > 2 else np.array([])
    X = _design(days, t0, span, cps)
    base = np.linalg.lstsq(X[:, :2], ys, rcond=None)[0]
    s2 = float(np.mean((ys - X[:, :2] @ base) ** 2)) or 1e-12
    pen = np.zeros(X.shape[1])
    pen[2:2 + len(cps)] = s2 / prior ** 2
    pen[2 + len(cps):] = s2 / 10.0 ** 2
    beta = np.linalg.solve(X.T @ X + np.diag(pen + 1e-9), X.T @ ys)
    sigma = float(np.std(ys - X @ beta)) * scale
    return (_design(at_days.astype(float), t0, span, cps) @ beta) * scale, sigma


# --- grouped maps ----------------------------------------------------------------

def _epoch_days(d: pd.Series) -> np.ndarray:
    return (pd.to_datetime(d) - pd.Timestamp("1970-01-01")).dt.days.to_numpy(dtype=float)


def wmape(actual: np.ndarray, pred: np.ndarray) -> float:
    den = np.sum(np.abs(actual))
    return 0.0 if den == 0 else float(np.sum(np.abs(actual - pred)) / den)


ROUTE_SCHEMA = T.StructType([
    T.StructField("cloud_provider", T.StringType()), T.StructField("unified_category", T.StringType()),
    T.StructField("wmape_additive", T.DoubleType()), T.StructField("wmape_boosted_trees", T.DoubleType()),
    T.StructField("model_used", T.StringType())])

FORECAST_SCHEMA = T.StructType([
    T.StructField("cloud_provider", T.StringType()), T.StructField("unified_category", T.StringType()),
    T.StructField("date", T.DateType()), T.StructField("predicted_cost", T.DoubleType()),
    T.StructField("lower_bound", T.DoubleType()), T.StructField("upper_bound", T.DoubleType()),
    T.StructField("model_used", T.StringType())])


def _route(pdf: pd.DataFrame, n_val: int) -> tuple[float, float, str]:
    y = pdf["cleaned_cost"].to_numpy(dtype=float)
    split = len(y) - n_val
    if split < 15:
        return 0.0, 0.0, fixed.GBT_MODEL
    tr, va = pdf.iloc[:split], pdf.iloc[split:]
    ytr, yva = y[:split], y[split:]
    days = _epoch_days(tr["date"])
    # the additive model forecasts the days right after the training data
    fut = days[-1] + np.arange(1, n_val + 1)
    add_pred, _ = additive_fit_predict(ytr, days, fut)
    gbt_pred, _ = gbt_fit_forecast(ytr, tr["date"], list(va["date"]))
    wa, wg = wmape(yva, add_pred), wmape(yva, gbt_pred)
    return wa, wg, (fixed.ADDITIVE_MODEL if wa < wg else fixed.GBT_MODEL)


def backtest_route(series: DataFrame, n_val: int = fixed.VALIDATION_DAYS) -> DataFrame:
    """Last ``n_val`` days held out; WMAPE of both models; the additive
    model is chosen only when strictly better (tie -> boosted trees)."""
    def fn(pdf):
        pdf = pdf.sort_values("date").reset_index(drop=True)
        wa, wg, m = _route(pdf, n_val)
        return pd.DataFrame([(pdf["cloud_provider"].iloc[0], pdf["unified_category"].iloc[0], wa, wg, m)],
                            columns=[f.name for f in ROUTE_SCHEMA.fields])
    return series.select(*S, "date", "cleaned_cost").groupBy(*S).applyInPandas(fn, ROUTE_SCHEMA)


def production_forecast(series: DataFrame, horizon: int = fixed.HORIZON_DAYS,
                        n_val: int = fixed.VALIDATION_DAYS) -> DataFrame:
    """Route, refit the chosen model on the whole series and forecast
    ``horizon`` days with a 90 % band, clamped at 0."""
    z = fixed.INTERVAL_Z

    def fn(pdf):
        pdf = pdf.sort_values("date").reset_index(drop=True)
        _, _, m = _route(pdf, n_val)
        y = pdf["cleaned_cost"].to_numpy(dtype=float)
        last = pd.Timestamp(pdf["date"].iloc[-1])
        nd = [last + pd.Timedelta(days=h) for h in range(1, horizon + 1)]
        if m == fixed.ADDITIVE_MODEL:
            pred, sd = additive_fit_predict(y, _epoch_days(pdf["date"]), _epoch_days(pd.Series(nd)))
        else:
            pred, sd = gbt_fit_forecast(y, pdf["date"], nd)
        return pd.DataFrame({"cloud_provider": pdf["cloud_provider"].iloc[0],
                             "unified_category": pdf["unified_category"].iloc[0],
                             "date": [d.date() for d in nd], "predicted_cost": np.maximum(0, pred),
                             "lower_bound": np.maximum(0, pred - z * sd),
                             "upper_bound": np.maximum(0, pred + z * sd), "model_used": m})
    return series.select(*S, "date", "cleaned_cost").groupBy(*S).applyInPandas(fn, FORECAST_SCHEMA)


GBT_SCHEMA = T.StructType([
    T.StructField("cloud_provider", T.StringType()), T.StructField("unified_category", T.StringType()),
    T.StructField("date", T.DateType()), T.StructField("gbt_forecast", T.DoubleType())])

ADD_SCHEMA = T.StructType([
    T.StructField("cloud_provider", T.StringType()), T.StructField("unified_category", T.StringType()),
    T.StructField("date", T.DateType()), T.StructField("additive_forecast", T.DoubleType()),
    T.StructField("additive_lower", T.DoubleType()), T.StructField("additive_upper", T.DoubleType())])


def gbt_forecast(series: DataFrame, horizon: int = fixed.HORIZON_DAYS) -> DataFrame:
    """Boosted trees on lags 1/7/14, 7-day mean and weekday; recursive
    ``horizon``-day forecast, clamped at 0."""
    def fn(pdf):
        pdf = pdf.sort_values("date").reset_index(drop=True)
        last = pd.Timestamp(pdf["date"].iloc[-1])
        nd = [last + pd.Timedelta(days=h) for h in range(1, horizon + 1)]
        pred, _ = gbt_fit_forecast(pdf["cleaned_cost"].to_numpy(dtype=float), pdf["date"], nd,
                                   lags=(1, 7, 14))
        return pd.DataFrame({"cloud_provider": pdf["cloud_provider"].iloc[0],
                             "unified_category": pdf["unified_category"].iloc[0],
                             "date": [d.date() for d in nd], "gbt_forecast": np.maximum(0, pred)})
    return series.select(*S, "date", "cleaned_cost").groupBy(*S).applyInPandas(fn, GBT_SCHEMA)


def additive_forecast(series: DataFrame, horizon: int = fixed.HORIZON_DAYS) -> DataFrame:
    """I8: fitted values over the history plus ``horizon`` future days, with
    the 90 % band."""
    z = fixed.INTERVAL_Z

    def fn(pdf):
        pdf = pdf.sort_values("date").reset_index(drop=True)
        days = _epoch_days(pdf["date"])
        fut = days[-1] + np.arange(1, horizon + 1)
        at = np.concatenate([days, fut])
        pred, sd = additive_fit_predict(pdf["cleaned_cost"].to_numpy(dtype=float), days, at)
        dates = [dt.date(1970, 1, 1) + dt.timedelta(days=int(d)) for d in at]
        return pd.DataFrame({"cloud_provider": pdf["cloud_provider"].iloc[0],
                             "unified_category": pdf["unified_category"].iloc[0], "date": dates,
                             "additive_forecast": pred, "additive_lower": pred - z * sd,
                             "additive_upper": pred + z * sd})
    return series.select(*S, "date", "cleaned_cost").groupBy(*S).applyInPandas(fn, ADD_SCHEMA)
