"""Sharding by a Hilbert curve over several metadata dimensions (DataFrame only).

Each dimension is quantised to ``bits`` bits: numbers by approximate
quantiles, other types by a hash, so that equal values share a cell. Rows are
ordered by the curve index of their cell and cut into runs of equal row
counts. A run covers few cells in every dimension, so a reader that filters on
any of them prunes files by their minimum and maximum.

The global position of a row never needs one ordered partition: rows are
counted per (cell, bucket), the counts become offsets, and only one
(cell, bucket) is ever numbered by one task. ``buckets`` splits a cell that
holds most rows. The cell count is at most ``2 ** (bits * dimensions)``.

Nulls in a dimension take the lowest cell; an empty table gives no rows and
keeps the columns; repeated rows each get a slot of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

MAX_CELL_BITS = 16


def curve_index(axes: list[Column], bits: int) -> Column:
    """The Hilbert index of integer coordinates in [0, 2**bits), by John
    Skilling's transform (AIP Conf. Proc. 707, 2004) as folds over arrays."""
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i"))
                      for b in range(bits - 1, 0, -1) for i in range(n)]) if bits > 1 else None
    x = F.array(*[a.cast("int") for a in axes])

    def undo(acc: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        head, mine = acc[0], F.get(acc, i)
        swap = head.bitwiseXOR(mine).bitwiseAND(q - 1)
        flip = mine.bitwiseAND(q) != 0
        return F.transform(acc, lambda v, j: F.when(
            flip, F.when(j == 0, v.bitwiseXOR(q - 1)).otherwise(v)).otherwise(
            F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v)))

    if steps is not None:
        x = F.aggregate(steps, x, undo)

    def gray(v: Column) -> Column:
        return F.transform(v, lambda _, j: F.aggregate(
            F.slice(v, 1, j + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))

    def settle(v: Column) -> Column:
        last = F.get(v, F.lit(n - 1))
        t = F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)] or [F.lit(0)]), F.lit(0),
                        lambda a, q: F.when(last.bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
        return F.transform(v, lambda e: e.bitwiseXOR(t))

    def weave(v: Column) -> Column:
        order = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i"))
                          for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(order, F.lit(0).cast("long"), lambda a, s: a * 2 + F.when(
            F.get(v, s["i"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0).cast("long"))

    # each fold is bound to a lambda variable, so it is evaluated once a row
    def bind(value: Column, fn) -> Column:
        return F.transform(F.array(value), fn)[0]

    return bind(bind(bind(x, gray), settle), weave)


def quantise(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """One coordinate column per dimension; reads the numeric dimensions once."""
    numeric = [d for d in dims if isinstance(df.schema[d].dataType, NumericType)]
    cuts: dict[str, list] = {}
    if numeric:
        probs = [i / (1 << bits) for i in range(1, 1 << bits)]
        row = df.agg(*[F.percentile_approx(F.col(f"`{d}`"), probs, 10_000).alias(f"c{k}")
                       for k, d in enumerate(numeric)]).first()
        cuts = {d: sorted(set(row[k] or [])) for k, d in enumerate(numeric)}
    out = []
    for d in dims:
        c = F.col(f"`{d}`")
        if d in cuts:
            at = F.array(*[F.lit(v) for v in cuts[d]]) if cuts[d] else None
            code = F.size(F.filter(at, lambda v, c=c: v < c)) if at is not None else F.lit(0)
            out.append(F.when(c.isNull(), 0).otherwise(code).cast("int"))
        else:
            out.append(F.when(c.isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << bits))).cast("int"))
    return out


def hilbert_shards(df: DataFrame, dims: list[str], tie: list[Column], n_shards: int,
                   bits: int = 3, buckets: int = 64) -> DataFrame:
    """``df`` with ``hilbert`` (curve index), ``shard`` and ``slot``.

    Shard sizes differ by one row at most. ``tie`` orders the rows of a cell's
    bucket; rows equal in every tie column are interchangeable. Clashing
    column names of ``df`` are overwritten, except the dimensions.
    """
    if len(dims) * bits > MAX_CELL_BITS:
        raise ValueError(f"at most {MAX_CELL_BITS} bits over all dimensions")
    placed = (df.withColumn("hilbert", curve_index(quantise(df, dims, bits), bits))
              .withColumn("__b", F.pmod(F.xxhash64(*tie), F.lit(buckets)).cast("int")))
    counts = placed.groupBy("hilbert", "__b").agg(F.count(F.lit(1)).alias("__n"))
    cells = counts.groupBy("hilbert").agg(F.sum("__n").alias("__cell"))
    order = Window.orderBy("hilbert")      # at most 2**16 cells, whatever the rows
    cells = cells.select(
        "hilbert",
        (F.sum("__cell").over(order) - F.col("__cell")).alias("__before"),
        F.sum("__cell").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))
    inside = Window.partitionBy("hilbert").orderBy("__b")
    offsets = (counts.withColumn("__in", F.sum("__n").over(inside) - F.col("__n"))
               .join(cells, "hilbert")
               .select("hilbert", "__b", (F.col("__before") + F.col("__in")).alias("__off"), "__all"))
    numbered = placed.withColumn("__r", F.row_number().over(
        Window.partitionBy("hilbert", "__b").orderBy(*tie)) - 1)
    pos = (F.col("__off") + F.col("__r")).cast("long")
    first = F.expr(f"(shard * __all + {n_shards - 1}) div {n_shards}")
    return (numbered.join(offsets, ["hilbert", "__b"])
            .withColumn("__pos", pos)
            .withColumn("shard", F.expr(f"(__pos * {n_shards}) div __all").cast("int"))
            .withColumn("slot", (F.col("__pos") - first).cast("long"))
            .drop("__b", "__off", "__all", "__r", "__pos"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order, so that Parquet's minimum
    and maximum prune files and row groups on every dimension."""
    (sharded.repartition("shard").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Documents in shards by size, language, source and id. The text itself
    is not shuffled: its length and checksum are taken at the scan."""
    text = F.col("text")
    slim = docs.select(
        "doc_id", "lang", "source",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"))
    tie = [F.col(c) for c in ("doc_id", "text_crc32", "text_hash", "lang", "source")]
    return hilbert_shards(slim, ["size", "lang", "source", "doc_id"], tie, n_shards).drop("text_hash")
