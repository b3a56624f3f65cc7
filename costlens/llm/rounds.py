"""Components of near-duplicate classes that meet under common keys, in rounds.

A key (a token of a prefix, a band of samples) may be held by any number of
classes, and all pairs that hold one in common must be settled without being
written out. In a round about ``PIVOTS`` classes of a key, none of them in the
key's largest component, meet all others of the key, and each class proposes the
pivots most similar to it by parity bitmaps of the sets. Proposals are verified,
links join components, and rejected pairs are remembered. A key whose classes are
in one component is done; a pivot with no pair left that the bitmaps allow has
met everyone and leaves the key. So a round proposes at most ``PROPOSALS`` pairs
for each row, whatever the size of a group, a group of thousands of near copies
is joined by a few pairs a row, and no pair between two components that share a
key is left out. The rows of a large key are dealt into groups of a bounded size,
and only its pivots go to all of them. Bitmaps are compared within tasks, and
links are contracted to the components' own graph, which shrinks in every round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm.components import components
from costlens.llm.kernels import returning
from costlens.session import materialize

#: Bits of the parity bitmap of a whole set.
SET_BITS = 2048
#: Standard deviations by which a count may exceed its mean at the threshold.
SIGMAS = 6.5
#: Pivots of a key in a round, on average.
PIVOTS = 256
#: Rows of a key that meet its pivots in one group, on average.
ROWS_PER_GROUP = 512
#: Pairs that a row proposes in a round at most.
PROPOSALS = 2

_FAR = 1 << 30


def set_sketch(v: np.ndarray) -> bytes:
    """The parity bitmap of a whole set."""
    odd = np.bincount((v & np.uint64(SET_BITS - 1)).astype(np.int64), minlength=SET_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def most_of_sets(total: np.ndarray, percent: int) -> np.ndarray:
    """The population count of two whole sets with ``total`` shingles together
    beyond which they don't link: linked ones have at most
    (100 - t) / (100 + t) * total shingles in one set only."""
    only = (100 - percent) * total // (100 + percent)
    mean = SET_BITS / 2 * (1 - np.exp(-2.0 * only / SET_BITS))
    spread = SET_BITS / 4 * (1 - np.exp(-4.0 * only / SET_BITS))
    return np.minimum(only, np.ceil(mean + SIGMAS * np.sqrt(spread)))


MET = "key long, pivot long, a long, b long, ca long, cb long"


def meet(dealt: DataFrame, percent: int, cut: int = 0) -> DataFrame:
    """Within groups of (key, salt), sorted within partitions: the pairs of each
    row with its ``PROPOSALS`` most similar pivots of other components (pivot is
    null), and each pivot that has such a pair with any row (a to cb are null).
    Before the set's bitmap a sketch may hold another one, of which at most
    ``cut`` bits may differ."""

    def one(g):
        import pyarrow as pa
        pivot = g.column("pivot").to_numpy(zero_copy_only=False).astype(bool)
        p, r = np.flatnonzero(pivot), np.flatnonzero(~pivot)
        if not len(p) or not len(r):
            return None
        cls, comp, n = (g.column(c).to_numpy() for c in ("cls", "comp", "n"))
        bits = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint64).reshape(len(cls), -1)
        words = bits.shape[1] - SET_BITS // 64
        z = np.empty((len(p), len(r)), np.int32)
        for k in range(0, len(p), 32):
            x = p[k:k + 32]
            odd = np.bitwise_count(bits[x, None] ^ bits[None, r])
            whole = odd[:, :, words:].sum(-1, dtype=np.int32)
            total = n[x, None] + n[None, r]
            off = (whole > most_of_sets(total, percent)) | (comp[x, None] == comp[None, r])
            off |= 100 * np.minimum(n[x, None], n[None, r]) < percent * np.maximum(n[x, None], n[None, r])
            if words:
                off |= odd[:, :, :words].sum(-1, dtype=np.int32) > cut
            z[k:k + 32] = np.where(off, _FAR, whole * 1000 // total)
        known = g.column("rejected").to_pylist()
        for j, x in enumerate(r):
            if known[x]:
                z[np.isin(cls[p], known[x]), j] = _FAR
        some = np.flatnonzero((z < _FAR).any(1))
        if not len(some):
            return None
        at_p, at_r = [], []
        for _ in range(min(PROPOSALS, len(p))):
            best = z.argmin(0)
            hit = np.flatnonzero(z[best, np.arange(len(r))] < _FAR)
            at_p.append(p[best[hit]])
            at_r.append(r[hit])
            z[best[hit], hit] = _FAR
        x, y = np.concatenate(at_p), np.concatenate(at_r)
        gone = [None] * len(some)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(x) + len(some), g.column("key")[0].as_py())),
             pa.array([None] * len(x) + cls[p[some]].tolist(), pa.int64()),
             *[pa.array(v.tolist() + gone, pa.int64()) for v in (np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y]), comp[x], comp[y])]],
            names=["key", "pivot", "a", "b", "ca", "cb"])

    def run(batches):
        import pyarrow as pa
        held = None

        def groups(t):
            key, salt = t.column("key").to_numpy(), t.column("salt").to_numpy()
            return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if not t.num_rows:
                continue
            cut_at = groups(t)
            for lo, hi in zip(cut_at[:-1], cut_at[1:]):
                if (out := one(t.slice(lo, hi - lo).combine_chunks())) is not None:
                    yield out
            held = t.slice(cut_at[-1])
        if held is not None and held.num_rows and (out := one(held.combine_chunks())) is not None:
            yield out

    return dealt.mapInArrow(lambda b: returning(run(b)), MET)


def unlike_keys(shared: DataFrame) -> DataFrame:
    """``shared`` (key, cls) with one key of those that the same classes hold: near
    copies have dozens of keys in common, and one settles them all."""
    held = shared.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("cls")).alias("x"),
                                     F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y"))
    return shared.join(held.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def join_rounds(info: DataFrame, shared: DataFrame, verify: Callable[[DataFrame], DataFrame], percent: int,
                cut: int = 0) -> DataFrame:
    """(cls, comp) of the classes of ``info`` (cls, n, sketch) by the links between
    classes that have a key of ``shared`` (key, cls) in common.
    ``verify`` tells of pairs (a, b) whether they are ``linked``. Both tables are
    read in every round: hand in written ones."""
    spark = info.sparkSession
    state = info.select("cls", F.col("cls").alias("comp"))
    rejects = spark.createDataFrame([], "a long, b long")
    live, number = shared, 0
    while True:
        number += 1
        rows = live.join(state, "cls")
        parts = (rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
                 .groupBy("key").agg(F.sum("c").alias("total"), F.max(F.struct("c", "comp")).alias("most"),
                                     F.count(F.lit(1)).alias("n_parts")).where("n_parts > 1"))
        odds = F.pmod(F.xxhash64("key", "cls", F.lit(number)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        rows = materialize(rows.join(parts, "key").select(
            "key", "cls", "comp", F.ceil(F.col("total") / ROWS_PER_GROUP).cast("int").alias("salts"),
            ((F.col("comp") != F.col("most.comp")) & (odds * (F.col("total") - F.col("most.c")) < PIVOTS)).alias("pivot")), "live-rows")
        if not rows.limit(1).count():
            return state
        both = rejects.union(rejects.select("b", "a"))
        known = both.groupBy(F.col("a").alias("cls")).agg(F.collect_list("b").alias("rejected"))
        own = F.pmod(F.xxhash64("cls", F.lit(number)), F.col("salts")).cast("int")
        # a pivot goes to every group of its key, and as a row to its own one
        places = F.when(F.col("pivot"), F.concat(
            F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct(s.alias("salt"), F.lit(True).alias("pivot"))),
            F.array(F.struct(own.alias("salt"), F.lit(False).alias("pivot"))))
        ).otherwise(F.array(F.struct(own.alias("salt"), F.lit(False).alias("pivot"))))
        dealt = (rows.select("key", "cls", "comp", F.explode(places).alias("at"))
                 .select("key", "cls", "comp", "at.*")
                 .join(info, "cls").join(known, "cls", "left")
                 .repartition("key", "salt").sortWithinPartitions("key", "salt"))
        met = materialize(meet(dealt, percent, cut), "met-pairs")
        if met.where("pivot IS NULL").limit(1).count():
            sides = F.struct(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
            pairs = met.where("pivot IS NULL").groupBy("a", "b").agg(F.min(sides).alias("c"))
            judged = materialize(pairs.join(verify(pairs.select("a", "b")), ["a", "b"])
                                 .select("a", "b", "c.ca", "c.cb", "linked"), "judged-pairs")
            # links join components, so only the components' own graph is walked
            joined = judged.where("linked").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
            if joined.limit(1).count():
                step = components(joined).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
                state = materialize(state.join(step, "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp")), "components")
            rejects = rejects.union(judged.where("NOT linked").select("a", "b"))
        # a pivot without a pair has met all of its key and leaves it
        busy = met.where("pivot IS NOT NULL").select("key", F.col("pivot").alias("cls")).distinct().withColumn("busy", F.lit(True))
        live = rows.join(busy, ["key", "cls"], "left").where("busy OR NOT pivot").select("key", "cls")
