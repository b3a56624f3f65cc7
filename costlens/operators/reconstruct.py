"""Sequence-reconstruction detector (tier 3).

Substitute model, stated plainly: the reference trains an LSTM
autoencoder; this build uses a rank-8 *linear* autoencoder, i.e. the
principal subspace of the 14 x 3 windows. The contract around the model is
kept: per-stream min-max scaling (B11), windows of the 14 previous rows
(F8), training only on label-clean rows with the windows built after the
filter (D8), a row's score excludes the row itself and is 0 before 14
predecessors (D9), threshold = 95th percentile of the real scores, strict
``>`` (D10). Scores are not comparable to the LSTM's.

Distributed fit: each task accumulates the Gram matrix of its windows
(42 x 42) and their sum with numpy, Spark sums those blocks per stream;
only 1,807 numbers per stream reach the eigen step, which runs per stream
in a grouped map. The fitted bases (42 x 8 per stream) are broadcast and
every window is scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens import fixed
from costlens.operators import aggregates as A
from costlens.operators import scale as SC
from costlens.operators import windows as W
from costlens.operators.keyed import join_stats, stream_id
from costlens.operators.positional import IDX, Ordered, more_tasks, positional_index, sub_index, with_halo
from costlens.schema import S
from costlens.session import materialize, share

DIM = fixed.SEQ_LEN * len(fixed.SEQ_FEATURES)
SCALED = [f"{f}_scaled" for f in fixed.SEQ_FEATURES]


def scaled_features(feat: DataFrame, keys: Sequence[str] = S) -> DataFrame:
    return SC.minmax_scale(feat, fixed.SEQ_FEATURES, keys)


def windowed_batches(batches, features: Sequence[str] = SCALED):
    """(batch, windows, which rows have one) of Arrow batches that come in the order
    of (_stream, _bucket, position): a row's window is the feature vectors of the
    ``SEQ_LEN`` rows before it, oldest first. The last rows of a batch stay in a
    buffer for the next one, so no window is ever stored."""
    import pyarrow as pa

    n_before, held, held_key = fixed.SEQ_LEN, np.zeros((0, len(features))), None
    for b in batches:
        if not b.num_rows:
            continue
        stream, bucket = b.column("_stream").to_numpy(), b.column("_bucket").to_numpy()
        X = np.stack([b.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features], axis=1)
        cut = np.flatnonzero(np.r_[True, (stream[1:] != stream[:-1]) | (bucket[1:] != bucket[:-1])])
        # rows of the same group before this batch
        lead = held if held_key == (stream[0], bucket[0]) else held[:0]
        rows = np.concatenate([lead, X])
        start = np.repeat(np.r_[0, cut[1:] + len(lead)], np.diff(np.r_[cut, len(X)]))
        at = np.arange(len(X)) + len(lead)
        has = at - start >= n_before
        windows = np.zeros((0, DIM))
        if has.any():
            view = np.lib.stride_tricks.sliding_window_view(rows, n_before, axis=0)     # [row, feature, step]
            windows = view[at[has] - n_before].transpose(0, 2, 1).reshape(int(has.sum()), DIM)
        yield b, windows, has
        last = cut[-1]
        tail = X[last:] if len(cut) > 1 else rows
        held, held_key = tail[-n_before:].copy(), (stream[-1], bucket[-1])


def in_order(df: DataFrame, idx: str, tasks: Sequence[int] = ()) -> DataFrame:
    """Buckets with their halo rows, each in the order of its positions."""
    return df.repartition(*tasks, "_stream", "_bucket").sortWithinPartitions("_stream", "_bucket", idx)


def _gram_part(features: Sequence[str] = SCALED):
    def part(batches):
        import pyarrow as pa
        acc: dict = {}
        for b, X, has in windowed_batches(batches, features):
            own = has & ~b.column("_halo").to_numpy(zero_copy_only=False)
            X, stream = X[own[has]], b.column("_stream").to_numpy()[own]
            for key in np.unique(stream):
                Y = X[stream == key]
                n, sm, g = acc.get(key, (0, 0.0, 0.0))
                acc[key] = (n + len(Y), sm + Y.sum(axis=0), g + Y.T @ Y)
        for key, (n, sm, g) in acc.items():
            v = np.concatenate([[float(n)], sm, np.asarray(g).reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), key, np.int64)), pa.array(np.arange(len(v), dtype=np.int32)),
                                              pa.array(v)], names=["_stream", "k", "v"])

    return part


GRAM = [T.StructField("_stream", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("v", T.DoubleType())]


def gram_stats(ordered: DataFrame, features: Sequence[str] = SCALED) -> DataFrame:
    """Per stream: n, the sum and the Gram matrix of the windows, as (_stream, k,
    v) rows with k = 0 (n), 1..DIM (sum), then DIM x DIM (Gram).

    Each task accumulates its partial sums with numpy (``X.T @ X``) and
    emits one small block per stream it saw; Spark sums the blocks."""
    return _summed(ordered.select("_stream", "_bucket", "_halo", *features).mapInArrow(_gram_part(features), T.StructType(GRAM)))


def _summed(partial: DataFrame) -> DataFrame:
    return partial.groupBy("_stream", "k").agg(F.sum("v").alias("v"))


MODEL_SCHEMA = "_stream long, mean array<double>, basis array<double>"


def _eigen_factory(k: int):
    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("k")["v"].to_numpy(dtype=float)
        n, sm, g = v[0], v[1:1 + DIM], v[1 + DIM:].reshape(DIM, DIM)
        mean = sm / n
        cov = g / n - np.outer(mean, mean)
        vals, vecs = np.linalg.eigh((cov + cov.T) / 2)
        basis = vecs[:, np.argsort(vals)[::-1][:k]]
        return pd.DataFrame([(int(key[0]), mean.tolist(), basis.reshape(-1).tolist())], columns=["_stream", "mean", "basis"])
    return fit


def fit_subspace(ordered: DataFrame, k: int = fixed.SEQ_HIDDEN) -> DataFrame:
    return _fitted(gram_stats(ordered), k)


def _fitted(grams: DataFrame, k: int = fixed.SEQ_HIDDEN) -> DataFrame:
    return grams.groupBy("_stream").applyInPandas(_eigen_factory(k), MODEL_SCHEMA)


SCORE = [T.StructField("dl_mse_score", T.DoubleType()), T.StructField("_scored", T.BooleanType())]


def _scorer(model: DataFrame, kept: Sequence[str], k: int = fixed.SEQ_HIDDEN, out: str = "dl_mse_score"):
    """Takes Arrow batches and gives their ``kept`` columns, the score and whether
    the row has a window."""
    packed = {r["_stream"]: (np.array(r["mean"]), np.array(r["basis"]).reshape(DIM, k)) for r in model.collect()}
    get_model = share(model.sparkSession, packed)

    def run(batches):
        import pyarrow as pa
        m = get_model()
        for b, X, has in windowed_batches(batches):
            score = np.zeros(b.num_rows)
            stream = b.column("_stream").to_numpy()[has]
            err = np.zeros(len(X))
            for key in np.unique(stream):
                if key in m:
                    mean, basis = m[key]
                    Y = X[stream == key] - mean
                    err[stream == key] = ((Y - (Y @ basis) @ basis.T) ** 2).mean(axis=1)
            score[has] = err
            own = pa.array(~b.column("_halo").to_numpy(zero_copy_only=False))
            rows = b.select(kept)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score), pa.array(has)],
                                             names=[*rows.schema.names, out, "_scored"]).filter(own)
    return run


def score_rows(ordered: DataFrame, model: DataFrame, k: int = fixed.SEQ_HIDDEN, out: str = "dl_mse_score") -> DataFrame:
    """Mean squared reconstruction error of each row's window, 0 without one, and
    whether it has one (``_scored``); halo rows go. A stream's model is 42 x 9
    numbers."""
    kept = [f for f in ordered.schema.fields if f.name not in ("_halo", "_bucket", "_stream")]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType()), T.StructField("_scored", T.BooleanType())])
    return ordered.mapInArrow(_scorer(model, [f.name for f in kept], k, out), schema)


def _scaled_batches(batches, bounds: dict[int, list]):
    """The batches with ``SCALED``: the features scaled to their stream's ``bounds``."""
    import pyarrow as pa
    for b in batches:
        if not b.num_rows:
            continue
        stream = b.column("_stream").to_numpy()
        cols = [b.column(f).cast(pa.float64()) for f in fixed.SEQ_FEATURES]
        X = np.stack([c.fill_null(0).to_numpy() for c in cols], axis=1)
        null = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in cols], axis=1)
        cut = np.flatnonzero(np.r_[True, stream[1:] != stream[:-1]])
        for a, z in zip(cut, np.r_[cut[1:], b.num_rows]):
            X[a:z], null[a:z] = W._scaled(X[a:z], null[a:z], bounds[int(stream[a])])
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(X[:, i], mask=null[:, i]) for i in range(X.shape[1]))],
                                         names=[*b.schema.names, *SCALED])


def score_in_passing(of: Ordered, first: Callable | None = None, needs: Sequence[str] = (),
                     adds: Sequence[T.StructField] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows of ``of``, as they are in its table, with ``SCORE``, and the
    features' ``minmax_stats``. The fit and the scores are scans of the table; its
    kept rows are the clean ones (D8). ``first`` may add ``adds`` to the batches on
    their way, from columns that it ``needs``."""
    feats = list(fixed.SEQ_FEATURES)
    stats = materialize(A.minmax_stats(of.rows(), feats, of.keys), "group-stats")
    bounds = {r["_stream"]: [(r[f"{f}_min"], r[f"{f}_max"]) for f in feats] for r in stats.select(
        stream_id(of.keys).alias("_stream"), *[F.col(c).cast("double") for c in stats.columns if c not in of.keys]).collect()}
    part = _gram_part()
    grams = _summed(of.in_passing(lambda b: part(_scaled_batches(b, bounds)), feats, GRAM, only=feats, kept=True))
    model = materialize(_fitted(grams), "seq-model")
    own = [*of.given, *of.adds]
    more = [c for c in dict.fromkeys([*feats, *needs]) if c not in own]
    run = _scorer(model, [*own, *(f.name for f in adds)])
    return of.in_passing(lambda b: run(_scaled_batches(first(b) if first else b, bounds)), [*own, *more], [*adds, *SCORE], only=more), stats


def flag_scores(scored: DataFrame, keys: Sequence[str] = S) -> DataFrame:
    """p95 of the real scores of each stream, and the flag of what is above. ``scored``
    is written."""
    th = A.exact_percentile(scored.where("_scored"), "dl_mse_score", fixed.SEQ_PERCENTILE, keys, out="_th", written=True)
    return join_stats(scored, th, keys, "left").withColumn(
        "dl_is_anomaly", F.when(F.col("_scored"), F.coalesce((F.col("dl_mse_score") > F.col("_th")).cast("int"), F.lit(0))).otherwise(0)
    ).drop("_th", "_scored")


def sequence_reconstruction(feat: DataFrame | Ordered, keys: Sequence[str] = S, bucket_rows: int | None = None) -> DataFrame:
    """Scale -> fit on windows of clean rows -> score every row -> p95 -> flag.

    One sort (the positional index, reused if ``feat`` has it) serves both: the
    clean subsequence (D8) is numbered from counts by bucket, and its windows, as
    those of all rows, are formed in passing from buckets with halo rows. Written
    are the scaled rows and the scored rows. Rows that are ``Ordered`` are not
    shuffled, nor scaled in a table: written are the scored rows."""
    if isinstance(feat, Ordered):
        rows, stats = score_in_passing(feat)
        scored = feat.made_of(materialize(rows, "seq-scored", compression="zstd")).drop(*feat.adds)
        out = flag_scores(SC.minmax_scale(scored, fixed.SEQ_FEATURES, keys, stats=stats), keys)
        last = ["dl_mse_score", "dl_is_anomaly"]
        return out.select(*[c for c in out.columns if c not in last], *last)
    given = IDX in feat.columns
    idx = feat if given else positional_index(feat, keys, W.spend_order(feat, keys))
    scaled = materialize(scaled_features(idx, keys).withColumn("_stream", stream_id(keys)), "seq-scaled")
    tasks = more_tasks(scaled, scaled.count())
    clean = sub_index(scaled, keys, F.col("is_anomaly") == 0, bucket_rows=bucket_rows).select("_stream", "_sub", *SCALED)
    model = fit_subspace(in_order(with_halo(clean, fixed.SEQ_LEN, idx="_sub", bucket_rows=bucket_rows), "_sub", tasks))
    full = in_order(with_halo(scaled, fixed.SEQ_LEN, bucket_rows=bucket_rows), IDX, tasks)
    scored = materialize(score_rows(full, model), "seq-scored")
    return flag_scores(scored, keys).drop(IDX)
