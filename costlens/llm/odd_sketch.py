"""Near-duplicate classes by MinHash bands and odd sketches.

1. Sets: every text becomes the set of its hashed word shingles; equal sets are
   one class from here on.
2. Samples: one permutation of the set's hashes is cut into ``SAMPLES`` bins
   and each bin keeps its least hash; an empty bin borrows from a bin chosen by
   a hash of its own number, the same for every set. Two sets agree in a sample
   with a probability of about their Jaccard similarity.
3. Bands: ``ROWS`` samples make a band, and classes that agree in a band are
   candidates. Two sets at exactly the threshold t agree in no band with a
   probability of (1 - t ** ROWS) ** BANDS: 9e-10 for 0.85 and 2e-6 for 0.8,
   less for every pair above. That is the only way a link can be lost.
4. Odd sketches: the samples of a set are folded into a bitmap that holds the
   parity of the samples which hash to each bit. The exclusive or of two
   bitmaps is the bitmap of the samples that only one of them holds, so its
   population count estimates their number, most precisely where it is small,
   that is for high similarities. A second bitmap folds the whole set, a sample
   without end: its count is at most the number of shingles that only one set
   holds. A candidate goes if the first count lies ``SIGMAS`` standard
   deviations beyond that of the threshold, or if the second is over what the
   threshold allows (or over ``SIGMAS`` deviations, where a set is so large that
   the bitmap is full).
5. The sets of the classes in the candidates that are left are built again from
   the texts and compared in full.

Candidates meet in rounds (``rounds.py``), so no group is written out in pairs.

Null texts and texts without words have an empty set and link with nothing;
fewer words than n are one shingle. Rows that repeat an id are documents of
their own with that id; a null id is a document whose id is never the least one
unless all of its component are null.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm.kernels import chain, mix
from costlens.llm.ngram_join import gram_sets, set_hash
from costlens.llm.rounds import SIGMAS, join_rounds, set_sketch
from costlens.session import materialize

ROWS = 6
BANDS = 44
SAMPLES = ROWS * BANDS
#: Bits of the odd sketch of the samples.
BITS = 1024

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def samples(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The samples [sets, SAMPLES] of sets of hashes; ``at`` is where each set
    begins in ``values``. Empty sets have the value of an empty bin throughout."""
    k = len(at) - 1
    h = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    bins = ((h >> np.uint64(40)) * np.uint64(SAMPLES) >> np.uint64(24)).astype(np.int64)
    place = np.repeat(np.arange(k, dtype=np.int64), np.diff(at)) * SAMPLES + bins
    order = np.argsort(place, kind="stable")
    flat = np.full(k * SAMPLES, _EMPTY, np.uint64)
    if len(order):
        sorted_place = place[order]
        first = np.flatnonzero(np.r_[True, sorted_place[1:] != sorted_place[:-1]])
        flat[sorted_place[first]] = np.minimum.reduceat(mix(h[order]), first)
    grid = flat.reshape(k, SAMPLES)
    own = grid != _EMPTY
    some = own.any(1)
    todo_row, todo_bin = np.nonzero(~own & some[:, None])
    step = 0
    while len(todo_row):
        # every set asks the same bins in the same order
        ask = (mix(todo_bin.astype(np.uint64) + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(SAMPLES)).astype(np.int64)
        got = own[todo_row, ask]
        grid[todo_row[got], todo_bin[got]] = grid[todo_row[got], ask[got]]
        todo_row, todo_bin = todo_row[~got], todo_bin[~got]
        step += 1
    return grid


def band_keys(grid: np.ndarray) -> np.ndarray:
    """A 64-bit key [sets, BANDS] of each band of the samples."""
    parts = grid.reshape(len(grid), BANDS, ROWS)
    number = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).ravel()
    return chain(number, *[parts[:, :, r].ravel() for r in range(ROWS)]).reshape(parts.shape[:2])


def odd_sketches(grid: np.ndarray) -> np.ndarray:
    """Parity bitmaps [sets, BITS / 8] of the samples with their numbers."""
    k = len(grid)
    bit = (mix(grid ^ mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))[None, :]) % np.uint64(BITS)).astype(np.int64)
    place = (np.arange(k, dtype=np.int64)[:, None] * BITS + bit).ravel()
    odd = np.bincount(place, minlength=k * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(k, BITS), axis=1, bitorder="little")


def most_odd(percent: int) -> int:
    """The population count beyond which two sets link with negligible odds:
    ``SIGMAS`` deviations of the number of unequal samples and of the fold."""
    t = percent / 100
    unequal = SAMPLES * (1 - t) + SIGMAS * math.sqrt(SAMPLES * t * (1 - t))
    only = 2 * min(unequal, SAMPLES)
    mean = BITS / 2 * (1 - math.exp(-2 * only / BITS))
    return min(BITS, math.ceil(mean + SIGMAS / 2 * math.sqrt(max(only - mean, 0) + 1)))


SET = "doc_id long, n long, cls long, bands array<long>"


def sketched(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, cls, bands) of each row; cls is a hash of its set."""

    def run(batches):
        import pyarrow as pa
        for b in batches:
            ids = b.column("doc_id")
            for i, values, at in gram_sets(b.column("text"), n):
                k = len(at) - 1
                grid = samples(values, at)
                full = np.diff(at) > 0
                cls = np.array([set_hash(values[at[d]:at[d + 1]]) if full[d] else 0 for d in range(k)], np.int64)
                keys = band_keys(grid).astype(np.int64)[full]
                off = np.concatenate(([0], np.cumsum(full * BANDS))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, k), pa.array(np.diff(at).astype(np.int64)), pa.array(cls),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(keys.ravel()))], names=["doc_id", "n", "cls", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, SET)


def with_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cls, n, sketch, grams) of the classes of ``wanted`` (doc_id, cls); grams
    are the sorted hashes of the set."""

    def run(batches):
        import pyarrow as pa
        for b in batches:
            named = b.column("cls").to_pylist()
            for i, values, at in gram_sets(b.column("text"), n):
                own = [values[at[d]:at[d + 1]] for d in range(len(at) - 1)]
                # rows that repeat a document's id may hold another text
                good = [d for d, v in enumerate(own) if len(v) and set_hash(v) == named[i + d]]
                odd = odd_sketches(samples(values, at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([named[i + d] for d in good], pa.int64()), pa.array([len(own[d]) for d in good], pa.int64()),
                     pa.array([odd[d].tobytes() + set_sketch(own[d]) for d in good], pa.binary()),
                     pa.array([own[d].tobytes() for d in good], pa.binary())], names=["cls", "n", "sketch", "grams"])

    named = wanted.select(F.col("doc_id").alias("of"), "cls")
    picked = docs.join(named, F.col("doc_id").eqNullSafe(F.col("of"))).select("cls", "text")
    return picked.mapInArrow(run, "cls long, n long, sketch binary, grams binary").dropDuplicates(["cls"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) by the full sets."""
    left = sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb"))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            linked = []
            for ga, gb in zip(b.column("ga").to_pylist(), b.column("gb").to_pylist()):
                x, y = np.frombuffer(ga, np.uint64), np.frombuffer(gb, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long, linked boolean")


def labelled(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n, comp) of each row of ``docs``; comp is null for empty sets."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialize(sketched(docs, n), "sketched")
    full = base.where("n > 0")
    classes = full.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("bands").alias("bands"))
    rows = materialize(classes.select("doc_id", "cls", F.explode("bands").alias("key")), "band-keys")
    ends = rows.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("key")
    shared = materialize(rows.join(ends, "key").select("key", "cls", "doc_id"), "shared-bands")
    wanted = shared.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    sets = materialize(with_sets(docs, wanted, n), "class-sets")
    comp = join_rounds(sets.select("cls", "n", "sketch"), shared.select("key", "cls"),
                       lambda pairs: verified(pairs, sets, percent), percent, most_odd(percent))
    return (full.select("doc_id", "n", "cls").join(comp, "cls", "left")
            .select("doc_id", "n", F.coalesce("comp", "cls").alias("comp"))
            .unionByName(base.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("comp"))))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``: rows
    whose sets of n-word shingles have a similarity of ``percent`` or more link,
    and a component has the id of its smallest document, which is kept."""
    rows = labelled(docs, n, percent)
    grouped = rows.where("n > 0")
    least = grouped.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = grouped.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
