"""Positional (row-count) windows that scale past one task per stream.

The detectors use frames such as "the 7 previous rows of this stream".
``Window.partitionBy(stream)`` would put a whole stream in one task, and a
stream can hold a third of all rows. Instead:

1. ``positional_index`` numbers the rows of each stream 0..n-1 in a total
   order. It sorts globally by range partitions, so a hot stream spreads over
   many tasks. Rows of equal sort keys are told apart by a hash of their
   content, and rows alike in everything by their place among the sorted rows
   of their input partition (the same however often a task is repeated, as such
   rows can't be told apart). So every row has a key of its own, and no run of
   ties, however long, has to fit into one partition.

   Prefix counts have two levels. Within a partition a row's place follows from
   the order of the rows. Across partitions, rows are counted by (partition,
   stream), and running sums of these counts, at most #partitions of them for a
   stream, are the offsets. No group is ever gathered in one task.

   The sorted, tagged frame is written once as a Parquet table in the
   shared ``spark.checkpoint.dir`` folder, so the counts and the rows agree
   even when the input is itself non-deterministic.

2. ``ordered_in_passing`` evaluates frames that reach back in the tasks that
   sort the rows, before they are written: no second shuffle and sort. Only the
   first rows of a stream in a partition miss rows of the partition before; they
   are computed again from the few rows around such cuts. The table it writes
   can be scanned for further frames (``Ordered.in_passing``): each row group has
   before it the rows that its first ones look back on.

3. ``framed`` evaluates row frames over fixed-size buckets of that index.
   The ``h`` rows just before a bucket are copied into it as read-only
   halo rows, so a frame reaching back ``h`` rows sees exactly the rows a
   per-stream window would. Every window partition holds at most
   ``bucket_rows + h`` rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.operators.keyed import join_stats, stream_id
from costlens.session import materialize

IDX = "_pos"
_PID = "_pid"
_LOCAL = "_local"
_HASH = "_hash"
_COPY = "_copy"
_ID = "_id"
#: Rows that a task sorts, on average, at most: some 300 MB.
SORT_ROWS = 1 << 20

DEFAULT_BUCKET_ROWS = int(os.environ.get("COSTLENS_BUCKET_ROWS", str(1 << 16)))


def more_tasks(df: DataFrame, rows: int) -> list[int]:
    """The first arguments of a repartition of ``rows`` rows: none, or a number of
    partitions where the session's own would be too large to be sorted in memory."""
    parts = rows // SORT_ROWS
    return [parts] if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def _in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], written: bool = False) -> DataFrame:
    """The rows in total order over range partitions. Those of a ``written`` table
    come in the order of its files, so equal rows are told apart by that and not
    by a sort."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    # a hash is of use only where the order leaves columns out
    whole = written and set(df.columns) <= {*keys, *(c for c in order if isinstance(c, str))}
    by = [*[F.col(k) for k in keys], *order_cols, *([] if whole else [F.col(_HASH)]), F.col(_COPY)]
    distinct = df if whole else df.withColumn(_HASH, F.xxhash64(*[F.col(c) for c in df.columns]))
    if not written:
        # no shuffle: a local sort puts equal rows side by side, so their numbers
        # don't depend on the order in which the rows arrived
        distinct = distinct.sortWithinPartitions(_HASH)
    return (distinct.withColumn(_COPY, F.monotonically_increasing_id())
                .repartitionByRange(*(more_tasks(df, df.count()) if written else []), *by)
                .sortWithinPartitions(*by)
                .drop(_HASH, _COPY))


def positional_index(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                     idx: str = IDX) -> DataFrame:
    """Add ``idx``: 0-based row number within ``keys`` ordered by ``order``.

    ``order`` must be a total order up to identical rows (identical rows may
    swap places without changing any result).
    """
    tagged = (_in_order(df, keys, order)
                .withColumn(_PID, F.spark_partition_id())
                .withColumn(_LOCAL, F.monotonically_increasing_id()
                            - F.shiftleft(F.col(_PID).cast("long"), 33)))
    # The counts and the rows must see the same partitions: materialise the
    # tagged frame once in the shared checkpoint folder (this also cuts the
    # lineage, so a lost executor re-reads it instead of re-sorting).
    tagged = materialize(tagged, "positional")
    # one row per (partition, stream): how many rows and where they start
    seg = tagged.groupBy(_PID, *keys).agg(F.count(F.lit(1)).alias("_n"),
                                          F.min(_LOCAL).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.select(_PID, *keys, (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_off"))
    # at most #partitions + #streams rows
    out = join_stats(tagged, seg, [_PID, *keys])
    return out.withColumn(idx, F.col("_off") + F.col(_LOCAL)).drop(_PID, _LOCAL, "_off")


def _marked(batches, far: int):
    """Arrow batches of sorted rows with ``_seg``, the number of the first row of
    their stream in the partition, ``_at``, their place from there, ``_gone``, how
    many rows between are not ``_kept``, and ``_cut``: whether fewer than ``far`` rows
    are between."""
    import numpy as np
    import pyarrow as pa

    held, seg, gone = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        stream, number = b.column("_stream").to_numpy(), b.column(_ID).to_numpy()
        new = np.r_[stream[0] != held, stream[1:] != stream[:-1]]
        last = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        segs = np.where(last < 0, seg, number[last])
        at = number - segs
        out = ~b.column("_kept").to_numpy(zero_copy_only=False)
        before = np.cumsum(out) - out
        lost = before - np.where(last < 0, -gone, before[last])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segs), pa.array(at), pa.array(lost), pa.array(at < far)],
                                         names=[*b.schema.names, *(f.name for f in _MARKS[:4])]).drop_columns([_ID])
        held, seg, gone = stream[-1], int(segs[-1]), int(lost[-1] + out[-1])


def _chunked(batches, reach: int, rows: int):
    """Arrow batches of marked rows with ``_chunk``, which counts parts of ``rows``
    rows, and ``_halo``. A part that begins within a stream has before it, once
    more and as halo rows, the last ``reach`` rows of the stream in the partition
    and the last ``reach`` of them that are ``_kept``."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    def put(b, halo: bool):
        more = [pa.array(np.full(b.num_rows, v)) for v in (chunk, halo)]
        return pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *(f.name for f in _MARKS[4:])])

    def ends(b):
        kept, n = np.flatnonzero(b.column("_kept").to_numpy(zero_copy_only=False)), b.num_rows
        return b.take(pa.array(np.union1d(kept[-reach:], np.arange(max(0, n - reach), n))))

    chunk, filled, tail = TaskContext.get().partitionId() << 33, 0, None
    for b in batches:
        done = 0
        while done < b.num_rows:
            if filled >= rows:
                chunk, filled = chunk + 1, 0
            if not filled and tail is not None:
                again = tail.filter(pa.array(tail.column("_seg").to_numpy() == b.column("_seg")[done].as_py()))
                if again.num_rows:
                    yield put(again, True)
                    filled = again.num_rows
            part = b.slice(done, rows - filled)
            yield put(part, False)
            filled, done = filled + part.num_rows, done + part.num_rows
            if reach:
                tail = ends(part) if tail is None else ends(pa.concat_batches([tail, ends(part)]))


_MARKS = [T.StructField("_seg", T.LongType()), T.StructField("_at", T.LongType()), T.StructField("_gone", T.LongType()),
          T.StructField("_cut", T.BooleanType()), T.StructField("_chunk", T.LongType()), T.StructField("_halo", T.BooleanType())]


@dataclass(frozen=True)
class Ordered:
    """Rows of streams in a written table, in order: what ``ordered_in_passing``
    gives. Its row groups are the parts of ``_chunked``. A row group is read by one
    task from its first row to its last, so frames that reach back at most
    ``reach`` rows, or ``reach`` rows that are kept, are formed in a scan: the rows
    are not shuffled again. ``edges`` holds the few rows whose frame may reach into
    the partition before, and those they need."""
    keys: Sequence[str]
    given: Sequence[str]
    adds: Sequence[str]
    table: DataFrame
    edges: DataFrame
    seg: DataFrame
    reach: int
    far: int
    made_of: Callable = lambda df: df

    def rows(self, idx: str | None = None) -> DataFrame:
        """Each row once, with its number in the stream, if ``idx`` names one."""
        place = [F.col("_seg"), F.col("_at")] if idx else []
        rows, edges = (df.select(*self.given, *self.adds, *place) for df in (
            self.table.where(~F.col("_halo") & ~F.col("_cut")), self.edges.where("_cut")))
        out = rows.unionByName(edges)
        if idx:
            out = out.join(self.seg.select("_seg", "_off"), "_seg").withColumn(idx, F.col("_off") + F.col("_at")).drop(
                "_seg", "_at", "_off")
        return self.made_of(out).drop(*self.adds)

    def in_passing(self, run: Callable, cols: Sequence[str], adds: Sequence[T.StructField] = (), only: Sequence[str] = (),
                   kept: bool = False) -> DataFrame:
        """What ``run`` makes of the rows, or of the ``kept`` ones: ``cols`` without
        ``only``, and ``adds``. It takes Arrow batches in the order of (_stream, _bucket,
        position) with ``cols`` and ``_halo``, marking rows that are only looked back on."""
        place = F.col("_at") - (F.col("_gone") if kept else 0)
        # rows with few of them before in their segment, and the segment's last ones
        near = place < self.far
        last = F.col("_len") - (F.col("_gone_all") if kept else 0) - place <= self.reach

        def ready(df: DataFrame, halo: Column, bucket: Column) -> DataFrame:
            df = (df.where("_kept") if kept else df).withColumns(
                {"_stream": stream_id(self.keys), "_bucket": bucket, "_halo": halo, "_nth": place})
            return self.made_of(df)

        needs = [*cols, "_stream", "_bucket", "_halo"]
        main = ready(self.table, F.col("_halo") | near, F.col("_chunk")).select(*needs, "_nth")
        edge = ready(self.edges.join(self.seg.select("_seg", "_len", "_gone_all"), "_seg").where(near | last), ~near, F.lit(0).cast("long"))
        edge = edge.repartition("_stream").sortWithinPartitions("_stream", "_seg", "_at").select(*needs)
        reach, schema = self.reach, T.StructType([*(main.schema[c] for c in cols if c not in only), *adds])
        return main.mapInArrow(lambda b: run(_whole(b, reach)), schema).unionByName(edge.mapInArrow(run, schema))

    def tables(self) -> list[DataFrame]:
        return [self.table, self.edges, self.seg]


def _whole(batches, reach: int):
    """The batches, if each row that is not only looked back on comes after the
    ``reach`` rows before it: an error else, as a frame would miss rows."""
    import numpy as np

    key, at, seen = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        stream, bucket, place = (b.column(c).to_numpy() for c in ("_stream", "_bucket", "_nth"))
        new = np.r_[key != (stream[0], bucket[0]) or place[0] != at + 1,
                    (stream[1:] != stream[:-1]) | (bucket[1:] != bucket[:-1]) | (place[1:] != place[:-1] + 1)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        run = np.where(first < 0, np.arange(len(new)) + seen, np.arange(len(new)) - first)
        if (run[~b.column("_halo").to_numpy(zero_copy_only=False)] < reach).any():
            raise RuntimeError("a sorted table was not read in its order")
        key, at, seen = (stream[-1], bucket[-1]), place[-1], int(run[-1]) + 1
        yield b.drop_columns(["_nth"])


def ordered_in_passing(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], run: Callable, needs: dict[str, Column],
                       adds: Sequence[T.StructField], before: int, reach: int = 0, kept: Column | None = None,
                       written: bool = False, made_of: Callable = lambda df: df) -> Ordered:
    """The rows in order, with columns that frames of the ``before`` rows before
    each row give. ``run`` takes Arrow batches in order, with ``_stream``, ``needs``
    and, where rows are only looked back on, ``_halo``; it gives all other columns and
    ``adds``. What it gives is written once, with the sorted rows, and frames of
    ``reach`` rows, or of ``reach`` rows that meet ``kept``, may be formed over it.
    ``made_of`` adds columns that follow from each row alone as often as it is read."""
    given, fields = df.columns, df.schema.fields
    far, chunk = before + reach, max(DEFAULT_BUCKET_ROWS, 8 * reach)
    needs = {**needs, "_kept": F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))}

    def ready(rows: DataFrame) -> DataFrame:
        return rows.withColumns({**needs, "_stream": stream_id(keys)})

    flag = T.StructField("_kept", T.BooleanType())
    ordered = ready(_in_order(df, keys, order, written).withColumn(_ID, F.monotonically_increasing_id()))
    tagged = materialize(ordered.mapInArrow(lambda b: _chunked(run(_marked(b, far)), reach, chunk),
                                            T.StructType([*fields, flag, *_MARKS[:4], *adds, *_MARKS[4:]])), "positional",
                         compression="zstd", maxRecordsPerFile="0", **{"parquet.block.row.count.limit": str(chunk)})
    # at most #partitions + #streams rows
    own = tagged.where("NOT _halo")
    seg = own.groupBy("_seg", *keys).agg(F.count(F.lit(1)).alias("_len"), F.count_if(~F.col("_kept")).alias("_gone_all"))
    w = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    seg = materialize(seg.select("_seg", "_len", "_gone_all", F.coalesce(F.sum("_len").over(w), F.lit(0)).alias("_off")), "group-stats")
    rows = own.join(seg, "_seg")
    # the first rows of a segment miss those of the segment before: a few rows of
    # a stream and partition are looked at for them
    marks = ["_seg", "_at", "_gone", "_cut"]
    cuts = rows.where(F.col("_cut") | (F.col("_len") - F.col("_at") <= before)).withColumn("_halo", ~F.col("_cut"))
    cuts = ready(cuts.select(*given, *marks, "_halo")).repartition("_stream").sortWithinPartitions("_stream", "_seg", "_at")
    edges = cuts.mapInArrow(run, T.StructType([*fields, *_MARKS[:4], flag, *adds]))
    if reach:
        n = F.col("_at") - F.col("_gone")
        near = (F.col("_len") - F.col("_at") <= reach) | (F.col("_kept") & ((n < far) | (F.col("_len") - F.col("_gone_all") - n <= reach)))
        edges = edges.unionByName(rows.where(~F.col("_cut") & near).select(*edges.columns))
    return Ordered(keys, given, [f.name for f in adds], tagged, materialize(edges, "positional-cuts"), seg, reach, far, made_of)


def framed_in_passing(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], run: Callable, needs: dict[str, Column],
                      adds: Sequence[T.StructField], before: int, written: bool = False, idx: str | None = IDX) -> DataFrame:
    """``positional_index`` (none, if ``idx`` is none) with the columns that
    ``ordered_in_passing`` gives: a scan, which may be read often."""
    return ordered_in_passing(df, keys, order, run, needs, adds, before, written=written).rows(idx)


def with_halo(df: DataFrame, before: int, after: int = 0, idx: str = IDX, bucket_rows: int | None = None) -> DataFrame:
    """Each row in its bucket (``_bucket``) of the index, and the last ``before``
    rows of a bucket also in the next one, the first ``after`` also in the one
    before, marked ``_halo``."""
    b = bucket_rows or DEFAULT_BUCKET_ROWS
    if b < max(before, after, 1):
        raise ValueError("bucket_rows must cover the frame")
    bucket = F.floor(F.col(idx) / b).cast("long")
    pos_in = F.col(idx) - bucket * b
    shifts = F.array(F.lit(0))
    if before > 0:
        shifts = F.when(pos_in >= b - before, F.array_append(shifts, F.lit(1))).otherwise(shifts)
    if after > 0:
        shifts = F.when((pos_in < after) & (bucket > 0),
                        F.array_append(shifts, F.lit(-1))).otherwise(shifts)
    return (df.withColumn("_shift", F.explode(shifts))
              .withColumn("_bucket", bucket + F.col("_shift"))
              .withColumn("_halo", F.col("_shift") != 0)
              .drop("_shift"))


def sub_index(df: DataFrame, keys: Sequence[str], where: Column, idx: str = IDX, out: str = "_sub",
              bucket_rows: int | None = None) -> DataFrame:
    """The rows of an indexed frame that meet ``where``, numbered 0..m-1 within
    ``keys`` in the same order: counts by bucket of the index become offsets, and
    a row's place within its bucket is a window of at most ``bucket_rows`` rows."""
    b = bucket_rows or DEFAULT_BUCKET_ROWS
    rows = df.where(where).withColumn("_part", F.floor(F.col(idx) / b).cast("long"))
    n = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    off = n.select(*keys, "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(idx)) - 1
    return join_stats(rows.withColumn("_in", place), off, [*keys, "_part"]).withColumn(
        out, F.col("_off") + F.col("_in")).drop("_part", "_in", "_off")


def framed(df: DataFrame, keys: Sequence[str], build: Callable[[Window], list[Column]],
           before: int, after: int = 0, idx: str = IDX,
           bucket_rows: int | None = None) -> DataFrame:
    """Evaluate row-frame expressions over an indexed frame.

    ``build(w)`` receives the window spec (partitioned by keys and bucket,
    ordered by ``idx``) and returns the new columns; frames must stay within
    ``before`` rows back and ``after`` rows ahead.
    """
    u = with_halo(df, before, after, idx, bucket_rows)
    w = Window.partitionBy(*keys, "_bucket").orderBy(idx)
    cols = build(w)
    return u.select("*", *cols).where(~F.col("_halo")).drop("_bucket", "_halo")
