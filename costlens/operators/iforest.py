"""I4: isolation forest per stream (Liu, Ting & Zhou, 2008).

Plan, sized for streams of any length:

1. Samples. Each tree sees min(256, n) rows, drawn from the whole stream: a row's
   chance doesn't depend on where or in which part of the stream it lies. Every
   row belongs to a tree's candidates with a probability of ``SPARE`` * 256 / n,
   decided by hashes of the row; the least 256 of fresh hashes are the sample (a
   bottom-k sample, which may be merged in any order). The first tree that a row
   is a candidate of comes from one hash by the geometric law, so of a long
   stream nearly all rows are passed over at the price of that hash.
2. Fit. Candidates are grouped by (stream, tree): some 512 rows a group, whatever
   the stream's length, and as many groups as trees.
3. Score. A forest has at most 100 trees of 511 nodes (about 2 MB). Streams are
   dealt into as many parts as forests of ``MODEL_BYTES`` need, each part's
   forests are broadcast, and every row is scored in Arrow batches with a
   vectorised tree walk (``mapInArrow``): no row is dropped.
4. The 5 % contamination cut is the exact distributed percentile (I5).

A null key is a stream. Where a tree can't split (a single row, or rows alike in
every feature) the score is 0.5, the value of a row that is neither isolated nor
dense.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens import fixed
from costlens.operators import detect as D
from costlens.operators.keyed import join_stats, stream_id
from costlens.schema import S
from costlens.session import materialize, share

#: Candidates of a tree for each row of its sample, on average. That a long
#: stream has fewer than 256 candidates lies eleven deviations off.
SPARE = 2.0
#: Bytes of the forests that are broadcast at once, on average.
MODEL_BYTES = 128 * 1024 * 1024
EULER = 0.5772156649015329
STREAM = "_stream"


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _unit(*cols) -> F.Column:
    """A hash in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def tree_candidates(df: DataFrame, features: Sequence[str], keys: Sequence[str] = S, trees: int = fixed.IFOREST_TREES,
                    samples: int = fixed.IFOREST_SAMPLES, seed: int = fixed.IFOREST_SEED) -> DataFrame:
    """(_stream, tree, _u, features): the rows from which each tree draws its
    sample, least ``_u`` first. Rows are told apart by their place in the stream
    where ``df`` has one (``_pos``), else by their content."""
    rows = df.select(*keys, *features, F.xxhash64(*sorted(c for c in df.columns)).alias("_h"))
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = join_stats(rows, n, keys).withColumn("_q", F.least(F.lit(1.0), F.lit(SPARE * samples) / F.col("_n")))
    # trees before the first one that takes the row: geometric
    first = F.when(F.col("_q") >= 1, F.lit(0.0)).otherwise(
        F.floor(F.log(1 - _unit("_h", F.lit(seed))) / F.log(1 - F.col("_q"))))
    rows = rows.withColumn("_first", first).where(F.col("_first") < trees)
    taken = F.filter(F.sequence(F.col("_first").cast("int"), F.lit(trees - 1)), lambda t: (t == F.col("_first")) | (
        _unit("_h", t, F.lit(seed)) < F.col("_q")))
    return (rows.select(stream_id(keys).alias(STREAM), "_h", *features, F.explode(taken).alias("tree"))
            .select(STREAM, "tree", _unit("_h", "tree", F.lit("sample")).alias("_u"), *features))


def _build_tree(X: np.ndarray, rng: np.random.Generator, limit: int):
    feat, thr, left, right, val = [], [], [], [], []
    stack = [(np.arange(len(X)), 0, -1, False)]
    while stack:
        idx, depth, parent, is_right = stack.pop()
        node = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), val.append(0.0)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        sub = X[idx]
        if depth >= limit or len(idx) <= 1:
            val[node] = depth + c_factor(len(idx))
            continue
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if len(usable) == 0:
            val[node] = depth + c_factor(len(idx))
            continue
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[node], thr[node] = f, t
        go_left = sub[:, f] <= t
        stack.append((idx[~go_left], depth + 1, node, True))
        stack.append((idx[go_left], depth + 1, node, False))
    return feat, thr, left, right, val


FOREST_SCHEMA = ("_stream long, tree int, psi int, feature array<int>, threshold array<double>, left array<int>, "
                 "right array<int>, value array<double>")


def fit_forest(df: DataFrame, features: Sequence[str] = tuple(fixed.IFOREST_FEATURES),
               keys: Sequence[str] = S, trees: int = fixed.IFOREST_TREES,
               samples: int = fixed.IFOREST_SAMPLES, seed: int = fixed.IFOREST_SEED) -> DataFrame:
    """One row per (stream, tree)."""
    names = list(features)

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        stream, tree = int(key[0]), int(key[1])
        pdf = pdf.sort_values(["_u", *names], kind="stable").head(samples)
        X = pdf[names].to_numpy(dtype=float)
        psi = len(X)
        rng = np.random.default_rng([seed, stream & (1 << 64) - 1, tree])
        nodes = _build_tree(X, rng, int(math.ceil(math.log2(max(psi, 2)))))
        return pd.DataFrame([(stream, tree, psi, *nodes)], columns=[
            STREAM, "tree", "psi", "feature", "threshold", "left", "right", "value"])

    drawn = tree_candidates(df, features, keys, trees, samples, seed)
    return drawn.groupBy(STREAM, "tree").applyInPandas(fit, FOREST_SCHEMA)


#: Rows that walk the trees together: their places in a hundred trees fit in a
#: core's cache.
WALK_ROWS = 512


@dataclass
class Forest:
    """The trees of a stream, node after node, children side by side. A leaf
    leads to itself."""
    cuts: list[np.ndarray]      # of each feature, the thresholds of all trees
    node: np.ndarray            # first child << 32 | place of the threshold << 8 | feature
    value: np.ndarray
    roots: np.ndarray
    levels: int
    psi: int

    def depths(self, X: np.ndarray) -> np.ndarray:
        """The mean depth of each row. ``x <= threshold`` holds where the place of
        x among a feature's thresholds is not above the threshold's own."""
        m, n_f = X.shape
        place = np.empty((m, n_f), np.int64)
        for f, cuts in enumerate(self.cuts):
            place[:, f] = np.searchsorted(cuts, X[:, f], "left")
        out = np.empty(m)
        for i in range(0, m, WALK_ROWS):
            part = place[i:i + WALK_ROWS].reshape(-1)
            row = np.arange(0, len(part), n_f)
            at = np.repeat(self.roots[:, None], len(row), 1)
            for _ in range(self.levels):
                node = self.node[at]
                x = part[(node & 255) + row]
                at = (node >> 32) + (x > (node >> 8 & 0xFFFFFF))
            out[i:i + WALK_ROWS] = self.value[at].mean(axis=0)
        return out


def _forest(rows: list, n_f: int) -> Forest:
    """A leaf's threshold lies above all places, so the walk stays there."""
    feature, threshold = (np.concatenate([np.asarray(r[c]) for r in rows]) for c in ("feature", "threshold"))
    cuts = [np.unique(threshold[feature == f]) for f in range(n_f)]
    nodes, values, roots, levels, first = [], [], [], 0, 0
    for r in rows:
        fe, th, lf, rt, va = (np.asarray(r[c]) for c in ("feature", "threshold", "left", "right", "value"))
        inner = np.flatnonzero(fe >= 0)
        # children side by side: the root, then the pairs of all inner nodes
        new = np.zeros(len(fe), np.int64)
        new[lf[inner]] = 1 + 2 * np.arange(len(inner))
        new[rt[inner]] = 2 + 2 * np.arange(len(inner))
        place = np.full(len(fe), 0xFFFFFF, np.int64)
        for f in range(n_f):
            place[fe == f] = np.searchsorted(cuts[f], th[fe == f])
        child = new.copy()
        child[inner] = new[lf[inner]]
        packed, value = np.empty(len(fe), np.int64), np.empty(len(fe))
        packed[new] = child + first << 32 | place << 8 | np.maximum(fe, 0)
        value[new] = va
        depth = np.zeros(len(fe), np.int64)
        for k in inner:             # parents come before their children
            depth[lf[k]] = depth[rt[k]] = depth[k] + 1
        levels = max(levels, int(depth.max()))
        nodes.append(packed), values.append(value), roots.append(first)
        first += len(fe)
    return Forest(cuts, np.concatenate(nodes), np.concatenate(values), np.array(roots), levels, rows[0]["psi"])


def _pack(forest_rows, n_f: int) -> dict[int, Forest]:
    by: dict[int, list] = {}
    for r in forest_rows:
        by.setdefault(r[STREAM], []).append(r)
    return {k: _forest(sorted(rs, key=lambda r: r["tree"]), n_f) for k, rs in by.items()}


def score_rows(df: DataFrame, forest: DataFrame, features: Sequence[str] = tuple(fixed.IFOREST_FEATURES),
               out: str = "iforest_score", keys: Sequence[str] = S) -> DataFrame:
    """Anomaly score s = 2^(-E[h(x)] / c(psi)) for every row (higher = more
    isolated). ``forest`` is read once a part, so hand in a written table."""
    parts = parts_of(forest)
    df = df.withColumn(STREAM, stream_id(keys))
    done = [_score_part(df.where(F.pmod(STREAM, F.lit(parts)) == i) if parts > 1 else df,
                        forest.where(F.pmod(STREAM, F.lit(parts)) == i), features, out) for i in range(parts)]
    scored = done[0]
    for more in done[1:]:
        scored = scored.unionByName(more)
    return scored.drop(STREAM)


def parts_of(forest: DataFrame) -> int:
    """How many parts the streams are dealt into."""
    nodes = forest.agg(F.sum(F.size("feature")).alias("n")).first()["n"] or 0
    return max(1, -(-nodes * 28 // MODEL_BYTES))


def scorer(forest: DataFrame, features: Sequence[str] = tuple(fixed.IFOREST_FEATURES)) -> Callable:
    """Takes Arrow batches with ``_stream`` and gives them with a last column, the
    score. All of ``forest`` is broadcast."""
    get_model = share(forest.sparkSession, _pack(forest.collect(), len(features)))
    feats = list(features)

    def run(batches, out: str = "iforest_score"):
        import pyarrow as pa
        model = get_model()
        for b in batches:
            stream = b.column(STREAM).to_numpy()
            X = np.stack([b.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in feats], axis=1)
            score = np.full(b.num_rows, 0.5)
            for key in np.unique(stream).tolist():
                if key not in model or model[key].psi <= 1:
                    continue
                own = np.flatnonzero(stream == key)
                score[own] = np.power(2.0, -model[key].depths(X[own]) / c_factor(model[key].psi))
            yield b.append_column(out, pa.array(score))
    return run


def _score_part(df: DataFrame, forest: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    run = scorer(forest, features)
    # the other columns stay in Arrow
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])
    return df.mapInArrow(lambda b: run(b, out), schema)


def isolation_forest(feat: DataFrame, keys: Sequence[str] = S,
                     features: Sequence[str] = tuple(fixed.IFOREST_FEATURES), written: bool = False) -> DataFrame:
    """I4 + I5: score every row, flag scores above the stream's 95th
    percentile (``ml_is_anomaly``)."""
    # the features feed the pool and the scoring: materialise them once, unless
    # they are ``written`` already
    feat = feat if written else materialize(feat, "iforest-features")
    forest = materialize(fit_forest(feat, features, keys), "iforest-trees")
    # scored rows feed both the percentile and the flag join: materialise
    # them once in the checkpoint folder instead of scoring twice
    scored = materialize(score_rows(feat, forest, features, keys=keys), "iforest-scored")
    return D.contamination_flag(scored, "iforest_score", keys, written=True)
