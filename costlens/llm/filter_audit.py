"""Interaction audit of filters by contractions of a contingency tensor.

Five filters judge every document; each part of the corpus gets a tensor of
2 x 2 x 2 x 2 x 2 counts, one axis a filter, index 0 for pass and 1 for fail
(and two more for the good and the toxic documents). Any question about an order
of the filters is then a contraction with one vector an axis: pass [1, 0], fail
[0, 1] or all [1, 1]. What step k removes, for example, has ``fail`` on its own
axis, ``pass`` on those before it and ``all`` on those after it. So 120 orders of
five steps cost no further look at the documents.

Documents are judged once, in the tasks that read them; from there on only
(id, text digest, part, flags) travels. Filter E needs the least id of each text
in the whole table. As the other flags are the same for equal texts, copies are
added up by (text, part, labels) with their least id, then by text: the rows of
a cell that fail E are all but those with the text's least id. No row is joined
back to its group, so a text with a third of all rows is summed up before any
shuffle.

Null text is empty: it has no word, fails A only (0 of 0 distinct words is not
under half, 0 capitals are not over 2 %), and equals other empty texts. A null
``doc_id`` is no smaller than any id and no id is smaller than it, so such rows
never fail E, and no label belongs to them. Rows equal in id and text don't make
each other fail. Labels that repeat an id count as the greatest of each column.
Null parts and empty ones are one part, the empty string.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm.kernels import SPACE, byte_table, runs, span_hashes, string_buffers, word_bounds
from costlens.session import materialize

FILTERS = "ABCDE"
#: Fixed values of the conditions.
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
SYMBOLS = b"#$%&*|"

#: Each order of the filters, with its steps.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[np.frombuffer(chars, np.uint8)] = 1
    return t


def flags_of(col) -> np.ndarray:
    """Bits 0 to 3 of each text: whether it fails A, B, C, D."""
    table = byte_table(fold_ascii=False)
    capital = _table(bytes(range(65, 91)))
    symbol = _table(SYMBOLS)
    point = np.ones(256, np.int64)
    point[0x80:0xC0] = 0                     # the bytes that continue a code point
    raw, off = string_buffers(col)
    out = []
    for i, j in runs(off):
        data, o = raw[off[i]:off[j]], off[i:j + 1] - off[i]
        s, e = word_bounds(data, o, SPACE)
        words = np.diff(np.searchsorted(s, o))
        h = span_hashes(data, s, e, table)
        doc = np.repeat(np.arange(j - i), words)
        order = np.lexsort((h, doc))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (doc[1:] != doc[:-1])
        distinct = np.bincount(doc[new], minlength=j - i)       # lexsort leaves doc as it is
        points, capitals, symbols = (np.diff(np.r_[0, np.cumsum(t[data])][o]) for t in (point, capital, symbol))
        out.append((words < LEAST_WORDS) * 1 + (100 * distinct < DISTINCT_PERCENT * words) * 2
                   + (100 * capitals > CAPITAL_PERCENT * points) * 4 + (symbols > 0) * 8)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


JUDGED = "doc_id long, part string, digest binary, flags int"


def judged(docs: DataFrame, part: str) -> DataFrame:
    """(doc_id, part, digest of the text, flags of A to D) of each document."""

    def run(batches):
        import hashlib

        import pyarrow as pa
        for b in batches:
            text = b.column("text")
            raw, off = string_buffers(text)
            digest = [hashlib.sha256(raw[x:y]).digest() for x, y in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), pa.array(digest, pa.binary()), pa.array(flags_of(text), pa.int32())],
                names=["doc_id", "part", "digest", "flags"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, JUDGED)


def cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, flags, n, good, toxic): the occupied cells of each part's tensors."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("of")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    rows = materialize(judged(docs, part), "judged")
    # without an id there is no label, and no task for all of them
    known = rows.where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("of"), "left").drop("of")
    rest = rows.where("doc_id IS NULL").select("*", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    rows = known.unionByName(rest).na.fill(0, ["good", "toxic"])
    alike = ["digest", "part", "flags", "good", "toxic"]
    # rows equal in id and text first: a cell's least id then has its count beside it
    same = rows.groupBy("doc_id", *alike).agg(F.count(F.lit(1)).alias("n"))
    groups = same.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    groups = materialize(groups, "text-groups")
    least = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    first = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    told = groups.join(least, "digest").select("part", "flags", "good", "toxic", "n", (first + F.col("nameless")).alias("ok"))
    split = told.select("part", "good", "toxic", F.explode(F.array(
        F.struct("flags", F.col("ok").alias("n")),
        F.struct((F.col("flags") + 16).alias("flags"), (F.col("n") - F.col("ok")).alias("n")))).alias("x"))
    return split.groupBy("part", F.col("x.flags").alias("flags")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"),
        F.sum(F.col("x.n") * F.col("toxic")).alias("toxic")).where("n > 0")


def selections() -> dict[str, np.ndarray]:
    """The vectors [orders * steps, filters, 2] of each question."""
    out = {k: [] for k in ("kept", "removed", "failing", "alone")}
    for order in ORDERS:
        for step, own in enumerate(order):
            before = set(order[:step])
            for name, mine, earlier, later in (("kept", _PASS, _PASS, _ALL), ("removed", _FAIL, _PASS, _ALL),
                                               ("failing", _FAIL, _ALL, _ALL), ("alone", _FAIL, _PASS, _PASS)):
                out[name].append([mine if f == own else earlier if f in before else later for f in FILTERS])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def contract(tensor: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The tensor [2, 2, 2, 2, 2] under each selection."""
    return np.einsum("abcde,sa,sb,sc,sd,se->s", tensor, *[vectors[:, k] for k in range(5)], optimize=True)


REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step. A part's cells, at most
    32, meet in one row, and its orders are answered from that row."""
    held = cells(docs, labels, part).groupBy("part").agg(
        F.collect_list(F.struct("flags", "n", "good", "toxic")).alias("cells"))

    def run(batches):
        import pyarrow as pa
        ask = selections()
        names = [o for o in ORDERS for _ in o]
        own = np.array([FILTERS.index(f) for o in ORDERS for f in o])
        steps = np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))
        for b in batches:
            for name, found in zip(b.column("part").to_pylist(), b.column("cells").to_pylist()):
                flat = np.zeros((3, 32), np.int64)
                for c in found:
                    flat[:, c["flags"]] = c["n"], c["good"], c["toxic"]
                # bit k of the flags is axis k
                count, good, toxic = (x.reshape([2] * 5).transpose(4, 3, 2, 1, 0) for x in flat)
                kept, removed, failing, alone = (contract(count, ask[k]) for k in ("kept", "removed", "failing", "alone"))
                shapley = np.zeros(5, np.int64)
                np.add.at(shapley, own, removed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(names)), pa.array(names), pa.array(steps), pa.array(kept), pa.array(removed),
                     pa.array(failing - removed), pa.array(alone), pa.array(contract(good, ask["removed"])),
                     pa.array(contract(toxic, ask["removed"])), pa.array(shapley[own])],
                    names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                           "toxic_lost", "shapley"])

    return held.mapInArrow(run, REPORT)
