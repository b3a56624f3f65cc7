"""Robust seasonal-trend decomposition by LOESS on each stream's daily
series, run as a grouped map.

The daily series is Spark-aggregated first (E1), so a group holds one row
per day of one stream: its size is bounded by the calendar, never by the
data volume, and the streams decompose in parallel. Inside the group the
decomposition follows Cleveland, Cleveland, McRae & Terpenning (1990):
inner loop = detrend, cycle-subseries LOESS, low-pass filter, deseasonalise,
trend LOESS; outer loop = bisquare robustness weights from the remainder.
The series is positional (missing days are not filled), like the daily
index it comes from.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens import fixed
from costlens.schema import S


def _odd(x: float) -> int:
    v = int(math.ceil(x))
    return v if v % 2 else v + 1


def settings(period: int = fixed.STL_PERIOD) -> dict:
    seasonal = 7
    trend = _odd(1.5 * period / (1 - 1.5 / seasonal))
    low_pass = _odd(period + 1) if (period + 1) % 2 == 0 else period + 1
    return {"period": period, "seasonal": seasonal, "trend": trend, "low_pass": low_pass,
            "inner": 2, "outer": 15}


def _loess(y: np.ndarray, q: int, at: np.ndarray, rw: np.ndarray | None) -> np.ndarray:
    """Local-linear LOESS of y (at positions 0..n-1) with span q, evaluated
    at positions ``at`` (may lie one step outside 0..n-1); all evaluation
    points at once as an (len(at) x q) window matrix."""
    n = len(y)
    xs = np.asarray(at, dtype=float)
    qq = min(q, n)
    if q >= n:
        left = np.zeros(len(xs), dtype=np.int64)
    else:
        left = np.clip(xs - q // 2, 0, n - q).astype(np.int64)
    right = left + qq - 1
    h = np.maximum(xs - left, right - xs)
    if q > n:
        h = h + (q - n) // 2
    idx = left[:, None] + np.arange(qq)[None, :]
    r = np.abs(idx - xs[:, None])
    hh = h[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        tri = (1 - (r / hh) ** 3) ** 3
    w = np.where(r <= 0.999 * hh, np.where(r <= 0.001 * hh, 1.0, tri), 0.0)
    w = np.where(hh > 0, w, 1.0)
    if rw is not None:
        w = w * rw[idx]
    sw = w.sum(axis=1)
    ok = sw > 0
    w = np.divide(w, sw[:, None], out=np.zeros_like(w), where=ok[:, None])
    a = (w * idx).sum(axis=1)
    c = (w * (idx - a[:, None]) ** 2).sum(axis=1)
    adj = (h > 0) & (np.sqrt(c) > 0.001 * (n - 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        b = np.where(adj, (xs - a) / np.where(c > 0, c, 1.0), 0.0)
    w = w * np.where(adj[:, None], b[:, None] * (idx - a[:, None]) + 1.0, 1.0)
    out = (w * y[idx]).sum(axis=1)
    fallback = y[np.clip(np.round(xs).astype(np.int64), 0, n - 1)]
    return np.where(ok, out, fallback)


def _moving_average(x: np.ndarray, k: int) -> np.ndarray:
    c = np.cumsum(np.concatenate([[0.0], x]))
    return (c[k:] - c[:-k]) / k


def decompose(y: np.ndarray, period: int = fixed.STL_PERIOD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Robust STL: returns (trend, seasonal, residual)."""
    cfg = settings(period)
    n, p = len(y), period
    trend = np.zeros(n)
    seasonal = np.zeros(n)
    rw = None
    for outer in range(cfg["outer"] + 1):
        for _ in range(cfg["inner"]):
            detr = y - trend
            cyc = np.zeros(n + 2 * p)
            for s in range(p):
                sub = detr[s::p]
                m = len(sub)
                sub_rw = rw[s::p] if rw is not None else None
                sm = _loess(sub, cfg["seasonal"], np.arange(-1, m + 1, dtype=float), sub_rw)
                cyc[s::p][:m + 2] = sm[:len(cyc[s::p])]
            low = _moving_average(_moving_average(_moving_average(cyc, p), p), 3)
            low = _loess(low, cfg["low_pass"], np.arange(n, dtype=float), None)
            seasonal = cyc[p:p + n] - low
            trend = _loess(y - seasonal, cfg["trend"], np.arange(n, dtype=float), rw)
        if outer == cfg["outer"]:
            break
        r = np.abs(y - seasonal - trend)
        h = 6.0 * np.median(r)
        u = r / h if h > 0 else np.zeros(n)
        rw = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u ** 2) ** 2, 0.0))
    return trend, seasonal, y - trend - seasonal


STL_SCHEMA = T.StructType([
    T.StructField("cloud_provider", T.StringType()), T.StructField("unified_category", T.StringType()),
    T.StructField("date", T.DateType()), T.StructField("cost", T.DoubleType()),
    T.StructField("stl_trend", T.DoubleType()), T.StructField("stl_seasonal", T.DoubleType()),
    T.StructField("stl_resid", T.DoubleType())])


def _stl_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("date").reset_index(drop=True)
    y = pdf["cost"].to_numpy(dtype=float)
    if len(y) < 2 * fixed.STL_PERIOD:
        z = np.zeros(len(y))
        tr, se, re = z, z, z
    else:
        tr, se, re = decompose(y)
    return pd.DataFrame({"cloud_provider": pdf["cloud_provider"], "unified_category": pdf["unified_category"],
                         "date": pdf["date"], "cost": y, "stl_trend": tr, "stl_seasonal": se,
                         "stl_resid": re})


def stl_residual(daily: DataFrame, keys: Sequence[str] = S) -> DataFrame:
    """STL components of each stream's daily cost. A stream shorter
    than two periods gets zeros (D6)."""
    if list(keys) != list(S):
        raise ValueError("stl_residual groups by stream")
    return daily.select(*keys, "date", "cost").groupBy(*keys).applyInPandas(_stl_group, STL_SCHEMA)


def stl_day_scores(daily: DataFrame, keys: Sequence[str] = S) -> DataFrame:
    """I3 (STL version): rolling z over 14 days of the STL residual and the
    |z| > 3 flag; zero for streams shorter than 14 days."""
    from pyspark.sql import Window
    st = stl_residual(daily, keys)
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(fixed.Z_WINDOW - 1), 0)
    mean = F.avg("stl_resid").over(w)
    std = F.stddev_samp("stl_resid").over(w)
    std = F.when(std.isNull() | (std == 0), F.lit(fixed.STD_FLOOR)).otherwise(std)
    z = F.coalesce((F.col("stl_resid") - mean) / std, F.lit(0.0))
    n_days = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    z = F.when(n_days < 2 * fixed.STL_PERIOD, F.lit(0.0)).otherwise(z)
    return st.withColumn("stat_z_score", z).withColumn(
        "stat_is_anomaly", (F.abs("stat_z_score") > fixed.Z_THRESHOLD).cast("int"))
