"""Window operators.

Two kinds of frames appear:

* row frames over raw spend rows (F1, F2, F8): a stream can be arbitrarily
  large, so these go through buckets with halos (``positional.with_halo``);
* frames over the daily series (F3-F7): one row per stream and day, so the
  series length is bounded by the calendar, not by the data volume; a plain
  ``Window.partitionBy(stream).orderBy(date)`` is the right plan there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens import fixed
from costlens.functions import columns as C
from costlens.operators.keyed import stream_id
from costlens.operators.positional import IDX, Ordered, more_tasks, ordered_in_passing, positional_index, with_halo
from costlens.schema import S
from costlens.session import materialize, release

# total order of spend rows inside a stream (D19: no order is left undefined)
SPEND_ORDER = ["timestamp", "cost", "normalized_env", "normalized_team", "is_anomaly",
               "anomaly_type"]


def spend_order(df: DataFrame, keys: Sequence[str] = S) -> list[str]:
    extra = [c for c in df.columns if c not in SPEND_ORDER and c not in keys and c != IDX]
    return [c for c in SPEND_ORDER if c in df.columns] + sorted(extra)


def _moments(c: Column, w: Window) -> tuple[Column, Column, Column]:
    return (F.count(c).over(w), F.sum(c).over(w),
            F.sum(c.cast("decimal(38,0)") * c.cast("decimal(38,0)")).over(w))


#: Whole numbers below this size are split for exact moments in 64 bits.
NEAR = 1 << 44
_HALF = 23


def moments_before(batches, k: int):
    """Arrow batches that come in the order of (_stream, position), or (_stream,
    _bucket, position) where there are buckets, halo rows left out, with ``_n``, ``_s`` and ``_spread`` of the ``k`` rows before
    each: the count and the sum of ``_u``, and n * (sum of squares) - sum^2 as a
    double, rounded as ``dec_to_double`` does. The last rows of a batch are kept for
    the next one. Values are split in two halves whose products fit in 64 bits;
    rows that see a value from ``NEAR`` on are computed with Python's integers."""
    import pyarrow as pa

    held, held_on, held_key = np.zeros(0, np.int64), np.zeros(0, bool), None
    for b in batches:
        if not b.num_rows:
            continue
        names = b.schema.names
        stream = b.column("_stream").to_numpy()
        bucket = b.column("_bucket").to_numpy() if "_bucket" in names else np.zeros(b.num_rows, np.int64)
        cut = np.flatnonzero(np.r_[True, (stream[1:] != stream[:-1]) | (bucket[1:] != bucket[:-1])])
        here = held_key == (stream[0], bucket[0])
        u, on = b.column("_u").fill_null(0).to_numpy(), b.column("_u").is_valid().to_numpy(zero_copy_only=False)
        u, on = (np.concatenate([x if here else x[:0], y]) for x, y in ((held, u), (held_on, on)))
        lead = len(u) - b.num_rows
        at = np.arange(b.num_rows) + lead
        start = np.repeat(np.r_[0, cut[1:] + lead], np.diff(np.r_[cut, b.num_rows]))
        n, total, aa, ab, bb, sa, sb = (np.zeros(b.num_rows, np.int64) for _ in range(7))
        far = np.zeros(b.num_rows, bool)
        wide = (u >= NEAR) | (u <= -NEAR)
        near = np.where(wide, 0, u)
        half, rest = near >> _HALF, near & (1 << _HALF) - 1
        for i in range(1, k + 1):
            has = at - start >= i
            j = np.maximum(at - i, 0)
            has &= on[j]
            x, y = half[j] * has, rest[j] * has
            n, total, far = n + has, total + u[j] * has, far | (wide[j] & has)
            sa, sb, aa, ab, bb = sa + x, sb + y, aa + x * x, ab + x * y, bb + y * y
        # the result is high * 2^46 + mid * 2^24 + low
        high, mid, low = n * aa - sa * sa, n * ab - sa * sb, n * bb - sb * sb
        t = ((mid & 255) << 24) + low
        spread = ((high << 14) + (mid >> 8) + (t >> 32)).astype(float) * 4294967296.0 + (t & 0xFFFFFFFF).astype(float)
        for r in np.flatnonzero(far):
            i = lead + r
            seen = [int(u[j]) for j in range(max(int(start[r]), i - k), i) if on[j]]
            upper, lower = divmod(len(seen) * sum(v * v for v in seen) - sum(seen) ** 2, 1 << 32)
            spread[r] = float(upper) * 4294967296.0 + float(lower)
        kept = [c for c in names if c not in ("_stream", "_bucket", "_halo", "_u")]
        out = pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n), pa.array(total), pa.array(spread)],
                                         names=[*kept, "_n", "_s", "_spread"])
        yield out.filter(pa.array(~b.column("_halo").to_numpy(zero_copy_only=False))) if "_halo" in names else out
        # rows before the last group's first one are never looked up
        held, held_on = (x[max(int(start[-1]), len(u) - k):].copy() for x in (u, on))
        held_key = (stream[-1], bucket[-1])


def _scaled(X: np.ndarray, null: np.ndarray, bounds: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """``scale.minmax_scale`` of a stream's feature vectors, which are null where
    ``null`` says so."""
    X, null = X.copy(), null.copy()
    for f, (lo, hi) in enumerate(bounds):
        if lo is None:
            continue        # no value at all
        if lo == hi or (lo != lo and hi != hi):
            X[:, f], null[:, f] = 0.0, False
        else:
            X[:, f] = (X[:, f] - lo) / (hi - lo)
    return X, null


def rows_before(batches, features: Sequence[str], k: int, out: str, bounds: dict[int, list] | None = None):
    """Arrow batches that come in the order of (_stream, _bucket, position), halo
    rows left out, with ``out``: the values of ``features`` in the ``k`` rows before
    each, oldest first, null where there are fewer. The last rows of a batch are
    kept for the next one. With ``bounds``, the least and greatest values of each
    stream, the values are scaled and the row's own come before ``out``."""
    import pyarrow as pa

    n_f = len(features)
    held, held_null, held_key = np.zeros((0, n_f)), np.zeros((0, n_f), bool), None
    for b in batches:
        if not b.num_rows:
            continue
        stream, bucket = b.column("_stream").to_numpy(), b.column("_bucket").to_numpy()
        cut = np.flatnonzero(np.r_[True, (stream[1:] != stream[:-1]) | (bucket[1:] != bucket[:-1])])
        cols = [b.column(f).cast(pa.float64()) for f in features]
        X = np.stack([c.fill_null(0).to_numpy() for c in cols], axis=1)
        null = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in cols], axis=1)
        if bounds is not None:
            for a, z in zip(cut, np.r_[cut[1:], b.num_rows]):
                X[a:z], null[a:z] = _scaled(X[a:z], null[a:z], bounds[int(stream[a])])
        here = held_key == (stream[0], bucket[0])
        X, null = (np.concatenate([h if here else h[:0], x]) for h, x in ((held, X), (held_null, null)))
        lead = len(X) - b.num_rows
        at = np.arange(b.num_rows) + lead
        start = np.repeat(np.r_[0, cut[1:] + lead], np.diff(np.r_[cut, b.num_rows]))
        own = ~b.column("_halo").to_numpy(zero_copy_only=False)
        at, has = at[own], (at - start >= k)[own]

        def before(a: np.ndarray) -> np.ndarray:
            if not has.any():
                return np.zeros(0, a.dtype)
            view = np.lib.stride_tricks.sliding_window_view(a, k, axis=0)       # [row, feature, step]
            return view[at[has] - k].transpose(0, 2, 1).reshape(-1)

        values = pa.array(before(X), mask=before(null) if null.any() else None)
        ends = np.r_[0, np.cumsum(has)] * (k * n_f)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.r_[~has, False]), values)
        kept = [c for c in b.schema.names if c not in ("_stream", "_bucket", "_halo")]
        rows = b.select(kept).filter(pa.array(own))
        more = {} if bounds is None else {f"{f}_scaled": pa.array(X[at, i], mask=null[at, i]) for i, f in enumerate(features)}
        yield pa.RecordBatch.from_arrays([*rows.columns, *more.values(), lists], names=[*kept, *more, out])
        held, held_null = (x[max(int(start[-1]), len(X) - k):].copy() for x in (X, null))
        held_key = (stream[-1], bucket[-1])


# --- F1 / F2 / B8 / B9 / B10: tier-2 row features ---------------------------
def spend_rows(spend: DataFrame, keys: Sequence[str] = S) -> DataFrame:
    """The spend rows as a written table. Each task sorts its rows first: rows that
    are alike lie side by side, in the table and in the shuffle that sorts them all."""
    return materialize(spend.sortWithinPartitions(*keys, *spend_order(spend, keys)), "spend-rows", compression="zstd")


def _with_features(df: DataFrame) -> DataFrame:
    n, s = F.col("_n"), F.col("_s")
    mean = F.when(n > 0, s.cast("double") / (n * C.UNITS))
    std = F.when(n >= 2, F.sqrt(F.col("_spread") / (n * (n - 1) * C.UNITS * C.UNITS)))
    return df.select(
        "*",
        C.day_of_week("timestamp").alias("day_of_week"),
        C.is_weekend("timestamp").alias("is_weekend"),
        F.coalesce(mean, F.lit(0.0)).alias("rolling_mean_7d"),
        F.coalesce(std, F.lit(0.0)).alias("rolling_std_7d"),
        F.coalesce(C.cost_ratio("cost", mean), F.lit(0.0)).alias("cost_ratio"),
    )


FEATURES = ["day_of_week", "is_weekend", "rolling_mean_7d", "rolling_std_7d", "cost_ratio"]
MOMENTS = [T.StructField("_n", T.LongType()), T.StructField("_s", T.LongType()), T.StructField("_spread", T.DoubleType())]


def ordered_features(spend: DataFrame, keys: Sequence[str] = S, reach: int = 0, kept: Column | None = None,
                     written: bool = False) -> Ordered:
    """``rolling_features`` as a table in which frames of ``reach`` rows (of those
    that meet ``kept``) are formed in a scan.

    The spend rows are read twice (to find the ranges and to sort), so they are
    written first unless the caller has ``written`` them. The moments are written
    with the sorted rows, the features follow from them where they are read."""
    own = spend if written else spend_rows(spend, keys)
    k = fixed.ROLL_WINDOW
    # one sort; the window operator would add up every row's frame anew
    out = ordered_in_passing(own, keys, spend_order(own, keys), lambda b: moments_before(b, k), {"_u": C.units("cost")},
                             MOMENTS, before=k, reach=reach, kept=kept, written=True, made_of=_with_features)
    if not written:
        release(own)
    return out


def rolling_features(spend: DataFrame, keys: Sequence[str] = S,
                     keep_index: bool = False, written: bool = False) -> DataFrame:
    """Adds day_of_week, is_weekend, rolling_mean_7d, rolling_std_7d and
    cost_ratio. The rolling frame is the 7 previous rows of the stream
    (current row excluded, at least one row); std is the sample std, 0 when
    fewer than two rows; every missing value becomes 0. The result is a scan of a
    written table and may be read often."""
    return ordered_features(spend, keys, written=written).rows(IDX if keep_index else None)


# --- F8: sequences of the previous 14 rows ----------------------------------
def stream_bounds(rows: DataFrame, features: Sequence[str], keys: Sequence[str]) -> tuple[int, dict[int, list]]:
    """The number of rows, and each stream's least and greatest value of each feature."""
    got = rows.groupBy(stream_id(keys).alias("_stream")).agg(F.count(F.lit(1)).alias("_rows"), *[
        g(F.col(f).cast("double")).alias(f"{f}_{g.__name__}") for f in features for g in (F.min, F.max)]).collect()
    return sum(r["_rows"] for r in got), {r["_stream"]: [(r[f"{f}_min"], r[f"{f}_max"]) for f in features] for r in got}


def _sequences_in_passing(of: Ordered, names: list[str], seq_len: int, out: str, scale: bool) -> DataFrame:
    if seq_len > of.reach:
        raise ValueError("the table's rows must reach as far back as the frame")
    rows = of.rows()
    bounds = stream_bounds(rows, names, of.keys)[1] if scale else None
    more = [T.StructField(f"{f}_scaled", T.DoubleType()) for f in names] if scale else []
    return of.in_passing(lambda b: rows_before(b, names, seq_len, out, bounds), rows.columns,
                         [*more, T.StructField(out, T.ArrayType(T.DoubleType()))])


def sequences(df: DataFrame | Ordered, features: Sequence[str], keys: Sequence[str] = S,
              order: Sequence[str] | None = None, seq_len: int = fixed.SEQ_LEN,
              bucket_rows: int | None = None, out: str = "window", scale: bool = False) -> DataFrame:
    """``out`` = the previous ``seq_len`` rows' feature vectors, flattened
    row-major (oldest first); null until ``seq_len`` predecessors exist. ``scale``
    adds the features scaled to their stream's range and makes windows of those:
    as ``minmax_scale`` before, with plain values in the shuffle. Rows that are
    ``Ordered`` are not shuffled."""
    if isinstance(df, Ordered):
        return _sequences_in_passing(df, list(features), seq_len, out, scale)
    order = order or spend_order(df, keys)
    given = IDX in df.columns
    idx = df if given else positional_index(df, keys, order)
    names = list(features)
    bounds, tasks, more = None, [], []
    if scale:
        rows, bounds = stream_bounds(idx, names, keys)
        tasks = more_tasks(idx, rows)
        more = [T.StructField(f"{f}_scaled", T.DoubleType()) for f in names]
    rows = with_halo(idx.withColumn("_stream", stream_id(keys)), seq_len, bucket_rows=bucket_rows)
    ordered = rows.repartition(*tasks, "_stream", "_bucket").sortWithinPartitions("_stream", "_bucket", IDX)
    schema = T.StructType([*idx.schema.fields, *more, T.StructField(out, T.ArrayType(T.DoubleType()))])
    res = ordered.select(*idx.columns, "_stream", "_bucket", "_halo").mapInArrow(
        lambda b: rows_before(b, names, seq_len, out, bounds), schema)
    return res if given else res.drop(IDX)


# --- daily-series windows ---------------------------------------------------
def daily_window(keys: Sequence[str] = S) -> Window:
    return Window.partitionBy(*keys).orderBy("date")


def rolling_z(daily: DataFrame, value_cents: str, keys: Sequence[str] = S,
              window: int = fixed.Z_WINDOW, out: str = "z", over: str | None = None) -> DataFrame:
    """(x - mean) / std over the last ``window`` rows including the
    current one; z = 0 when std is null or exactly 0 (the numerator is then
    0 as well). Exact integer moments, one sqrt, one division; z is reported to
    six places. ``over`` names a flag for abs(z) > 3 that is decided by the
    integers, z^2 > 9 without its root and division, so not by what is rounded."""
    w = daily_window(keys).rowsBetween(-(window - 1), 0)
    x = F.col(value_cents)
    n, s, q = _moments(x, w)
    var_num = n.cast("decimal(38,0)") * q - s.cast("decimal(38,0)") * s.cast("decimal(38,0)")
    z = F.when((n < 2) | (var_num == 0), F.lit(0.0)).otherwise(
        (n * x - s).cast("double") / F.sqrt(C.dec_to_double(var_num) * n / (n - 1)))
    daily = daily.select("*", F.round(z, 6).alias(out), *([] if over is None else [
        n.alias("_n"), (n * x - s).cast("decimal(38,0)").alias("_gap"), var_num.alias("_var")]))
    if over is None:
        return daily
    wide = F.col("_gap") * F.col("_gap") * (F.col("_n") - 1) > F.lit(int(fixed.Z_THRESHOLD ** 2)) * F.col("_n") * F.col("_var")
    return daily.withColumn(over, F.when((F.col("_n") < 2) | (F.col("_var") == 0), F.lit(0)).otherwise(wide.cast("int"))).drop(
        "_n", "_gap", "_var")


def centered_median(daily: DataFrame, value_cents: str = "cost_cents", keys: Sequence[str] = S,
                    width: int = fixed.MEDIAN_WINDOW, out: str = "rolling_median") -> DataFrame:
    """median of the ``width`` rows centred on each row (edges use what
    exists), as money."""
    h = width // 2
    w = daily_window(keys).rowsBetween(-h, h)
    return daily.withColumn(out, F.percentile(F.col(value_cents), F.lit(0.5)).over(w) / 100)


def clean_anomalies(daily: DataFrame, keys: Sequence[str] = S) -> DataFrame:
    """cleaned_cost = centred median on flagged days, cost otherwise."""
    d = centered_median(daily, keys=keys)
    return d.withColumn("cleaned_cost", F.when(F.col("had_anomaly") == 1, F.col("rolling_median"))
                        .otherwise(F.col("cost")))


def lags(daily: DataFrame, value: str, ks: Sequence[int] = (1, 7, 14),
         keys: Sequence[str] = S) -> DataFrame:
    """the value 1, 7, 14 rows back (positional, gaps are not filled)."""
    w = daily_window(keys)
    return daily.select("*", *[F.lag(value, k).over(w).alias(f"lag_{k}") for k in ks])


def rolling_mean_strict(daily: DataFrame, value_cents: str, keys: Sequence[str] = S,
                        k: int = fixed.ROLL_WINDOW, out: str = "rolling_mean_7") -> DataFrame:
    """mean of the k previous rows, null unless all k exist."""
    w = daily_window(keys).rowsBetween(-k, -1)
    n = F.count(F.col(value_cents)).over(w)
    s = F.sum(F.col(value_cents)).over(w)
    return daily.withColumn(out, F.when(n == k, s.cast("double") / (k * 100)))
