"""Jaccard self-join on word n-grams by adaptive multi-match prefixes.

Every text becomes a set of hashed n-grams. Sets are ordered by a global order
(estimated frequency, then hash), and only a prefix of each is indexed. With
``l`` as the number of shared prefix tokens asked for, a set of n grams that
needs an overlap of o = ceil(t * n) indexes its first n - o + l grams, and two
linked sets share at least min(l, l') of them. Each document takes the l, up
to ``MOST_SHARED``, with the least estimated cost: tokens indexed plus
candidates to verify, where candidates that must share l tokens number at most
the prefix's frequencies over l. Frequencies are estimates from a count table
of fixed size; they affect the cost only, never the result.

Equal sets are one class. Classes that share a prefix token meet under that token,
in the rounds of ``rounds.py``: pivots of a token meet all its classes and links
make components, so a group of thousands of near copies costs a few pairs each,
and no link between different components is left out. Tokens that the same classes
hold are one. A candidate is sent off by parity bitmaps of the sets, which bound
from below how many grams only one of them holds, then by the number of prefix
tokens it shares, before the sets themselves are compared.

Texts without words have an empty set and link with nothing; fewer words than
n are one gram. Sets and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm import counts
from costlens.llm.kernels import SPACE, byte_table, chain, returning, words_of
from costlens.llm.rounds import join_rounds, set_sketch, unlike_keys
from costlens.session import materialize, share

SKETCH_BITS = 18
MOST_SHARED = 4
#: What verifying a candidate costs against indexing a token.
VERIFY_COST = 4.0


def gram_sets(col, n: int):
    """For each run of texts: (first text, hashes sorted within each text and
    distinct, where each text's begin)."""
    table = byte_table()
    for i, _, o, _, _, h, w in words_of(col, SPACE, table):
        k = len(o) - 1
        size = np.diff(w)
        grams = chain(*[h[j:len(h) - n + 1 + j] for j in range(n)]) if len(h) >= n else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(k), np.maximum(size - n + 1, 0))
        at = np.repeat(w[:-1], np.maximum(size - n + 1, 0)) + (
            np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(size - n + 1, 0)) - np.maximum(size - n + 1, 0),
                                            np.maximum(size - n + 1, 0)))
        values = grams[at] if len(at) else np.zeros(0, np.uint64)
        short = np.flatnonzero((size > 0) & (size < n))
        if len(short):
            lone = np.array([chain(*[h[w[d] + j:w[d] + j + 1] for j in range(size[d])])[0] for d in short], np.uint64)
            doc, values = np.concatenate((doc, short)), np.concatenate((values, lone))
        order = np.lexsort((values, doc))
        doc, values = doc[order], values[order]
        keep = np.ones(len(doc), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
        doc, values = doc[keep], values[keep]
        yield i, values, np.searchsorted(doc, np.arange(k + 1))


def gram_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many sets hold a gram of each bucket, over all documents."""
    size = 1 << SKETCH_BITS

    def count(batches):
        t = np.zeros(size, np.int64)
        for b in batches:
            for _, values, _ in gram_sets(b.column("text"), n):
                t += np.bincount((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        yield from counts.emit({"all": t})

    tables = counts.collect_tables(counts.add_up(docs.select("text").mapInArrow(lambda b: returning(count(b)), counts.FIELDS)), size)
    return tables.get("all", np.zeros(size, np.int64))


def set_hash(v: np.ndarray) -> np.int64:
    """A hash of a set of grams, whatever their order."""
    return chain(np.array([np.bitwise_xor.reduce(v)]), np.array([v.sum(dtype=np.uint64)]),
                 np.array([len(v)], np.uint64))[0].astype(np.int64)


class Order:
    """The global order and the choice of l."""

    def __init__(self, table: np.ndarray, percent: int):
        load = table.mean()
        self.rank = np.maximum(table - load - 3 * np.sqrt(load), 0).astype(np.float32)
        self.percent = percent

    def arrange(self, values: np.ndarray) -> tuple[np.ndarray, int, int]:
        """(grams in order, l, prefix length)."""
        n = len(values)
        f = self.rank[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
        order = np.lexsort((values, f))
        need = -(-self.percent * n // 100)
        total = np.cumsum(f[order])
        most = min(MOST_SHARED, need)
        sizes = n - need + np.arange(1, most + 1)
        cost = sizes + VERIFY_COST * total[sizes - 1] / np.arange(1, most + 1)
        best = int(np.argmin(cost))
        return values[order], best + 1, int(sizes[best])


SET = "doc_id long, row long, n long, cls long, prefix array<long>, sketch binary"


def indexed(docs: DataFrame, table: np.ndarray, n: int, percent: int) -> DataFrame:
    """(doc_id, row, n, cls, prefix) of each document; cls is a hash of its set."""
    get = share(docs.sparkSession, Order(table, percent))

    def run(batches):
        import pyarrow as pa
        order = get()
        for b in batches:
            ids, rows = b.column("doc_id"), b.column("row")
            for i, values, at in gram_sets(b.column("text"), n):
                k = len(at) - 1
                cls, prefix, sketch = np.zeros(k, np.int64), [], []
                for d in range(k):
                    v = values[at[d]:at[d + 1]]
                    sketch.append(set_sketch(v) if len(v) else None)
                    if not len(v):
                        prefix.append(np.zeros(0, np.int64))
                        continue
                    cls[d] = set_hash(v)
                    g, _, p = order.arrange(v)
                    prefix.append(g[:p].astype(np.int64))
                off = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
                flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, k), rows.slice(i, k), pa.array(np.diff(at).astype(np.int64)), pa.array(cls),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), pa.array(sketch, pa.binary())],
                    names=["doc_id", "row", "n", "cls", "prefix", "sketch"])

    return docs.select("doc_id", "row", "text").mapInArrow(lambda b: returning(run(b)), SET)


def class_sets(docs: DataFrame, wanted: DataFrame, table: np.ndarray, n: int, percent: int) -> DataFrame:
    """(cls, l, prefix, grams) of the documents named by ``wanted`` (doc_id, cls):
    the prefix and all grams in the global order, as 64-bit integers."""
    get = share(docs.sparkSession, Order(table, percent))

    def run(batches):
        import pyarrow as pa
        order = get()
        for b in batches:
            cls = b.column("cls").to_pylist()
            for i, values, at in gram_sets(b.column("text"), n):
                # rows that repeat a document's id may hold another text
                own = [(c, v) for c, v in zip(cls[i:], (values[at[d]:at[d + 1]] for d in range(len(at) - 1)))
                       if len(v) and set_hash(v) == c]
                got = [order.arrange(v) for _, v in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in own], pa.int64()), pa.array([x[1] for x in got], pa.int32()),
                     pa.array([x[0][:x[2]].tobytes() for x in got], pa.binary()), pa.array([x[0].tobytes() for x in got], pa.binary())],
                    names=["cls", "l", "prefix", "grams"])

    named = wanted.withColumnRenamed("doc_id", "of")
    picked = docs.join(named, F.col("doc_id").eqNullSafe(F.col("of"))).select("cls", "text")
    return picked.mapInArrow(lambda b: returning(run(b)), "cls long, l int, prefix binary, grams binary").dropDuplicates(["cls"])


def _common(x: bytes, y: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of pairs (a, b): whether they share as many prefix tokens as
    the lesser of their two numbers l, and, only if so, whether their sets link."""

    def both(pairs, *names):
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("cls").alias(side), *[F.col(c).alias(c + side) for c in names]), side)
        return pairs

    def matched(batches):
        import pyarrow as pa
        for b in batches:
            c = b.to_pydict()
            enough = [_common(x, y) >= min(l, m) for x, y, l, m in zip(c["prefixa"], c["prefixb"], c["la"], c["lb"])]
            yield b.select(["a", "b"]).append_column("enough", pa.array(enough, pa.bool_()))

    def compared(batches):
        import pyarrow as pa
        for b in batches:
            c = b.to_pydict()
            linked = []
            for x, y in zip(c["gramsa"], c["gramsb"]):
                same = _common(x, y)
                linked.append(100 * same >= percent * (len(x) // 8 + len(y) // 8 - same))
            yield b.select(["a", "b"]).append_column("linked", pa.array(linked, pa.bool_()))

    tested = materialize(both(pairs, "l", "prefix").select("a", "b", "la", "lb", "prefixa", "prefixb").mapInArrow(
        lambda b: returning(matched(b)), "a long, b long, enough boolean"), "matched-pairs")
    full = both(tested.where("enough").select("a", "b"), "grams").select("a", "b", "gramsa", "gramsb").mapInArrow(
        lambda b: returning(compared(b)), "a long, b long, linked boolean")
    return full.unionByName(tested.where("NOT enough").select("a", "b", F.lit(False).alias("linked")))


def row_of(text):
    """A hash of the text as it is, null apart from empty."""
    return F.xxhash64(text.isNull(), text)


def labelled_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, row, n, comp) of each row of ``docs``: a hash of its text, the
    number of its grams and its component's label, null without words."""
    text = F.col("text").cast("string")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), row_of(text).alias("row"))
    table = gram_counts(docs, n)
    base = materialize(indexed(docs, table, n, percent), "gram-sets")
    full = base.where("n > 0")
    # one row per class of equal sets, whose rows have equal prefixes
    classes = materialize(full.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"),
                                                  F.max("prefix").alias("prefix"), F.max("sketch").alias("sketch")), "classes")
    postings = classes.select("cls", F.explode("prefix").alias("key"))
    # tokens of one class only go; a join, as it splits the rows of a hot token
    ends = postings.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("key")
    shared = materialize(unlike_keys(materialize(postings.join(ends, "key"), "shared-tokens")), "shared")
    held = classes.select("cls", "doc_id", "n", "sketch").join(shared.select("cls").distinct(), "cls", "left_semi")
    held = materialize(held, "held-classes")
    known: list[DataFrame] = []

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The sets of the classes in pairs. They are read from the texts when a
        class is first in a pair: most classes never are."""
        asked = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        for have in known:
            asked = asked.join(have.select("cls"), "cls", "left_anti")
        wanted = materialize(held.join(asked, "cls", "left_semi").select("cls", "doc_id"), "wanted")
        if wanted.limit(1).count():
            known.append(materialize(class_sets(docs, wanted, table, n, percent), "class-sets"))
        out = known[0] if known else spark.createDataFrame([], "cls long, l int, prefix binary, grams binary")
        for more in known[1:]:
            out = out.unionByName(more)
        return out

    def judge(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "proposed")
        return verify(pairs, sets_of(pairs), percent)

    comp = join_rounds(held.select("cls", "n", "sketch"), shared, judge, percent).withColumnRenamed("cls", "id")
    grouped = full.select("doc_id", "row", "n", "cls").join(comp.withColumnRenamed("id", "cls"), "cls", "left").select(
        "doc_id", "row", "n", F.coalesce("comp", "cls").alias("comp"))
    return grouped.unionByName(base.where("n = 0").select("doc_id", "row", "n", F.lit(None).cast("long").alias("comp")))


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``; rows that
    repeat an id are documents of their own with that id."""
    rows = labelled_rows(docs, n, percent)
    grouped = rows.where("n > 0")
    least = grouped.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = grouped.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component stays: that of its smallest id (null last),
    and of rows with that id the one of the least text hash. An id says nothing
    else: unlike texts that share one, or have none, all stay, as do documents
    without words."""
    rows = labelled_rows(docs, n, percent)
    by_row = rows.where("n > 0").groupBy("comp", "doc_id", "row").agg(F.count(F.lit(1)).alias("copies"))
    firsts = (by_row.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "copies")).alias("x"))
              .select(F.col("x.doc_id").alias("of"), F.col("x.row").alias("its"), F.col("x.copies").alias("copies")))
    empty = rows.where("n = 0").select(F.col("doc_id").alias("of"), F.col("row").alias("its"),
                                       F.lit(0).cast("long").alias("copies")).distinct()
    keep = materialize(firsts.unionByName(empty), "kept")
    out = docs.withColumn("__row", row_of(F.col("text").cast("string"))).join(
        keep, (F.col("__row") == F.col("its")) & F.col("doc_id").cast("long").eqNullSafe(F.col("of")))
    if not keep.where("copies > 1").limit(1).count():
        return out.select(*docs.columns)
    # texts are shuffled once more only for rows that repeat as a whole
    return (out.where("copies <= 1").select(*docs.columns)
            .unionByName(out.where("copies > 1").dropDuplicates(["doc_id", "__row"]).select(*docs.columns)))
