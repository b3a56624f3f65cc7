"""Exact top-k inner products by tiles of queries and candidate shards.

Both sides are packed into blocks of rows where they are read. Groups form a
grid: a block of queries goes to all groups of one row, a block of candidates to
all groups of one column, so each pair of blocks (a tile) meets in one group, by
an equi-join on the group's number. With p groups and queries that number a share
f of the candidates, a grid of sqrt(f p) rows ships the least. A tile is one matrix
product and keeps the k best candidates of each query, and a tree of merges with a
fixed fan-in reduces the lists. Neither side is broadcast, and a task holds two
blocks at a time.

Vectors that are null, or hold a null, NaN or infinite component, and rows
without an id take no part. A query's own row is told by its id, so rows that
repeat an id count as that same row. Vectors shorter than the longest of the
two blocks count as padded with zeros, also empty ones, whose scores are 0. Ties
go to the smaller id. Components and scores are 64-bit integers: one beyond that
range is an error and never a wrapped number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64.0
BLOCK = 2048
FAN_IN = 16
GROUPS = 12

BLOCKS = "block long, dim int, ids binary, mat binary"
LISTS = "q long, path long, qids binary, ids binary, scores binary"


def pack_blocks(vectors: DataFrame, id_col: str, vec_col: str, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """Rows in blocks of quantised vectors, floor(scale * x), as int64."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, block):
                piece = b.slice(lo, block)
                ids, rows = [], []
                for i, v in zip(piece.column(0).to_pylist(), piece.column(1)):
                    if i is None or not v.is_valid:
                        continue
                    x = np.array(v.as_py(), dtype=object)
                    if any(y is None for y in x):
                        continue
                    x = np.floor(scale * x.astype(np.float64))
                    if np.isfinite(x).all():
                        if (np.abs(x) >= 2.0 ** 63).any():
                            raise OverflowError(f"a component of vector {i} is no 64-bit integer once it is scaled")
                        ids.append(i)
                        rows.append(x)
                if ids:
                    dim = max(map(len, rows))
                    m = np.zeros((len(rows), dim), np.int64)
                    for r, x in zip(m, rows):
                        r[:len(x)] = x
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part * (1 << 32) + k], pa.int64()), pa.array([dim], pa.int32()),
                         pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                         pa.array([m.tobytes()], pa.binary())], names=["block", "dim", "ids", "mat"])
                    k += 1

    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(run, BLOCKS)


def _best(qids, ids, scores, k):
    """Row-wise k best: larger score first, then smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


_NONE = np.iinfo(np.int64).min + 1     # its negative is a number too


def _tile(qids, q, ids, m, k):
    """Top k of each query within one block; absent entries have id -1 and the
    least score."""
    dim = max(q.shape[1], m.shape[1])
    q = np.pad(q, ((0, 0), (0, dim - q.shape[1])))
    m = np.pad(m, ((0, 0), (0, dim - m.shape[1])))
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(m.astype(np.float64)).max(initial=0)) * dim
    if top < 2 ** 53:       # float products and sums are exact integers
        s = (q.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64)
    elif top < 2 ** 63:
        s = q @ m.T
    else:                   # Python's integers have no end
        s = q.astype(object) @ m.T.astype(object)
        s = np.where(qids[:, None] == ids[None, :], 0, s)      # a row's own product is no score
        if (abs(s) >= 2 ** 63 - 1).any():
            raise OverflowError("a score is no 64-bit integer")
        s = s.astype(np.int64)
    own = qids[:, None] == ids[None, :]
    keep = min(k, m.shape[0])
    # an id order first, then partial selection on the score alone, then the
    # ties at the edge by id
    order = np.argsort(ids, kind="stable")
    s, own, ids = s[:, order], own[:, order], ids[order]
    s = np.where(own, _NONE, s)
    if m.shape[0] > 4 * k:
        edge = -np.partition(-s, keep - 1, axis=1)[:, keep - 1:keep]
        above, at = s > edge, s == edge
        room = keep - above.sum(1, keepdims=True)
        take = above | (at & (np.cumsum(at, 1) <= room))
        cols = np.nonzero(take)[1].reshape(len(qids), keep)
    else:
        cols = np.broadcast_to(np.arange(m.shape[0]), s.shape)
    picked, got = np.take_along_axis(s, cols, 1), ids[cols]
    got = np.where(picked == _NONE, -1, got)
    return _best(qids, got, picked, k)


def _lists_out(q, path, qids, ids, scores):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays(
        [pa.array([q], pa.int64()), pa.array([path], pa.int64()), pa.array([qids.tobytes()], pa.binary()),
         pa.array([ids.tobytes()], pa.binary()), pa.array([scores.tobytes()], pa.binary())],
        names=["q", "path", "qids", "ids", "scores"])


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int,
          groups: int = GROUPS, share: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best other rows.
    ``share`` is about the number of queries over that of candidates."""
    spark = vectors.sparkSession
    groups = max(groups, int(spark.conf.get("spark.sql.shuffle.partitions")))
    down = max(1, min(groups, round((share * groups) ** 0.5)))
    across = -(-groups // down)
    groups = down * across

    def dealt(blocks, n):
        return F.pmod(F.xxhash64(blocks), F.lit(n)).cast("int")
    cand = pack_blocks(vectors, id_col, vec_col).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda r: r * across + dealt("block", across))).alias("g"),
        F.col("block").alias("cb"), F.col("dim").alias("cdim"), F.col("ids").alias("cids"), F.col("mat").alias("cmat"))
    ask = pack_blocks(queries, id_col, vec_col).withColumn("g", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(across - 1)), lambda c: dealt("block", down) * across + c)))
    tiles = ask.join(cand, "g").select("block", "dim", "ids", "mat", "cb", "cdim", "cids", "cmat")

    def products(batches):
        for b in batches:
            for r in range(b.num_rows):
                q, dim, ids, mat, cb, cdim, cids, cmat = (b.column(i)[r].as_py() for i in range(8))
                qids, cids = np.frombuffer(ids, np.int64), np.frombuffer(cids, np.int64)
                got, score = _tile(qids, np.frombuffer(mat, np.int64).reshape(len(qids), dim), cids,
                                   np.frombuffer(cmat, np.int64).reshape(len(cids), cdim), k)
                yield _lists_out(q, cb, qids, got, score)

    lists = tiles.mapInArrow(products, LISTS)

    def merged(key, pdf):
        import pandas as pd
        qids = np.frombuffer(pdf["qids"].iloc[0], np.int64)
        best_i = np.zeros((len(qids), 0), np.int64)
        best_s = best_i
        for i, s in zip(pdf["ids"], pdf["scores"]):
            i, s = (np.frombuffer(x, np.int64).reshape(len(qids), -1) for x in (i, s))
            best_i, best_s = _best(qids, np.hstack([best_i, i]), np.hstack([best_s, s]), k)
        return pd.DataFrame({"q": [key[0]], "path": [key[1]], "qids": [qids.tobytes()],
                             "ids": [best_i.tobytes()], "scores": [best_s.tobytes()]})

    # two levels of the tree for each FAN_IN in the number of groups; paths
    # are numbers below `width`
    width = groups * FAN_IN
    lists = lists.withColumn("path", F.pmod(F.xxhash64("path"), F.lit(width)))
    while True:
        lists = lists.groupBy("q", "path").applyInPandas(merged, LISTS)
        if width == 1:
            break
        width = -(-width // FAN_IN)
        lists = lists.withColumn("path", F.pmod("path", F.lit(width)))

    def rows(batches):
        import pyarrow as pa
        for b in batches:
            for r in range(b.num_rows):
                qids = np.frombuffer(b.column("qids")[r].as_py(), np.int64)
                ids, s = (np.frombuffer(b.column(c)[r].as_py(), np.int64).reshape(len(qids), -1)
                          for c in ("ids", "scores"))
                n = ids.shape[1]
                ok = (s != _NONE).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qids, n)[ok]), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(qids))[ok]),
                     pa.array(ids.ravel()[ok]), pa.array(s.ravel()[ok])], names=["query_id", "rank", "vec_id", "score"])

    return lists.mapInArrow(rows, "query_id long, rank int, vec_id long, score long")


def search_every(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Rows whose ``vec_id`` is divisible by ``every`` ask all other rows."""
    slim = vectors.select("vec_id", "embedding")
    return top_k(slim, slim.where(F.col("vec_id") % every == 0), "vec_id", "embedding", k, share=1 / every)
