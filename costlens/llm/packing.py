"""Packing documents into fixed-length sequences by column generation.

Documents are tokenised and cut: whole ``capacity`` pieces are sequences of
their own, the rest of a document is one piece. The cutting-stock problem of
the rests is solved over their length histogram (lengths in steps of
``step`` tokens, so the problem has at most ``capacity / step`` item types at
any input size): a linear program over patterns, whose columns an unbounded
knapsack prices, is rounded down, and what the rounding leaves is packed by
best fit decreasing over the same histogram. Documents are ranked within
their type, and rank arithmetic alone names the sequence of each.

Only the histogram reaches the driver. Empty and null texts count as a
document with the end token; repeated rows are documents of their own; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costlens.llm.kernels import returning
from costlens.llm.ranks import dense_rank_in
from costlens.llm.tokens import encode_texts, tokenizer_path
from costlens.session import materialize

END_ID = 2
CAPACITY = 4096
STEP = 16

PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row_key long")


def cut_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                  with_ids: bool = False) -> DataFrame:
    """One row per piece; ``ids`` (little-endian uint32) only if asked for.
    ``row_key`` tells repeated rows apart within a partition."""
    path = path or tokenizer_path()

    def run(batches):
        import zlib

        import pyarrow as pa
        end = np.array([END_ID], "<u4").tobytes()
        n_row = 0
        for b in batches:
            texts = b.column("text").fill_null("").to_pylist()
            ids = b.column("doc_id").to_pylist()
            for lo in range(0, len(texts), 256):
                cols = [[] for _ in range(7)]
                for d, e in zip(ids[lo:lo + 256], encode_texts(texts[lo:lo + 256], path)):
                    e += end
                    n = len(e) // 4
                    n_row += 1
                    for s in range(0, n, capacity):
                        part = e[4 * s:4 * (s + capacity)]
                        for c, v in zip(cols, (d, s, len(part) // 4, zlib.crc32(part), n, n_row, part)):
                            c.append(v)
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_key"]
                arrays = [pa.array(c, pa.int64()) for c in cols[:6]]
                if with_ids:
                    names, arrays = [*names, "ids"], [*arrays, pa.array(cols[6], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(lambda b: returning(run(b)), PIECE + (", ids binary" if with_ids else ""))


# ---- cutting stock over the histogram (driver, at most capacity/step types) ----

def price(duals: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The pattern of largest dual value: unbounded knapsack by dynamic
    programming, item t taking t + 1 units."""
    m = len(duals)
    best = np.zeros(units + 1)
    pick = np.full(units + 1, -1)
    for u in range(1, units + 1):
        k = min(u, m)
        value = best[u - 1::-1][:k] + duals[:k]
        j = int(np.argmax(value))
        best[u], pick[u] = best[u - 1], -1
        if value[j] > best[u] + 1e-12:
            best[u], pick[u] = value[j], j
    pattern, u = np.zeros(m, np.int64), units
    while u > 0:
        if pick[u] < 0:
            u -= 1
        else:
            pattern[pick[u]] += 1
            u -= pick[u] + 1
    return float(best[units]), pattern


#: Column generation ends when Farley's bound (the total over the best
#: column's value) is within this share of the total; its last columns gain
#: little and are the slowest.
GAP = 0.003


def inverse_of(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination by rows: a few hundred vector steps, without
    the threads of a matrix library, which stall next to a busy JVM."""
    m = len(a)
    work = np.hstack([a, np.eye(m)])
    for i in range(m):
        p = i + int(np.argmax(np.abs(work[i:, i])))
        work[[i, p]] = work[[p, i]]
        work[i] /= work[i, i]
        rows = np.flatnonzero(work[:, i])
        rows = rows[rows != i]
        work[rows] -= work[rows, i][:, None] * work[i]
    return work[:, m:]


def solve_lp(demand: np.ndarray, units: int, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Column generation with the revised simplex: (patterns, amounts)."""
    kinds = np.flatnonzero(demand)
    m = len(kinds)
    basis = np.zeros((m, m))
    for i, t in enumerate(kinds):
        basis[i, i] = units // (t + 1)
    inverse = np.diag(1.0 / np.diag(basis))
    amount = demand[kinds] / np.diag(basis)
    total, since = amount.sum(), 0
    for k in range(rounds):
        duals = np.zeros(len(demand))
        duals[kinds] = inverse.sum(0)
        value, pattern = price(np.maximum(duals, 0), units)
        if value <= 1 + GAP or since > 200:
            break
        column = pattern[kinds].astype(float)
        some = np.flatnonzero(column)         # sums, as threads of a matrix library cost more
        step = (inverse[:, some] * column[some]).sum(1)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        amount = amount - ratio[out] * step
        amount[out] = ratio[out]
        basis[:, out] = column
        if k % 200 == 199:
            inverse = inverse_of(basis)
            amount = np.maximum((inverse * demand[kinds]).sum(1), 0)
        else:
            pivot = inverse[out] / step[out]
            inverse = inverse - step[:, None] * pivot
            inverse[out] = pivot
        since = since + 1 if total - amount.sum() < 1e-6 * total else 0
        total = amount.sum()
    patterns = np.zeros((m, len(demand)), np.int64)
    patterns[:, kinds] = np.rint(basis.T).astype(np.int64)
    return patterns, np.maximum(amount, 0)


@dataclass
class Plan:
    """Per type: where its ranks go. ``upto[t]`` are the running totals of
    pieces, ``base``, ``each`` the first sequence and the pieces a sequence."""
    upto: list[np.ndarray]
    base: list[np.ndarray]
    each: list[np.ndarray]
    sequences: int


def best_fit(left: np.ndarray, units: int) -> list[tuple[np.ndarray, int]]:
    """Best fit decreasing as patterns and counts: the longest piece first, each
    into the sequence with the least room that holds it. Sequences filled alike
    are one group, and pieces of a type go to a group at once, so the work
    depends on the number of types and not on that of pieces."""
    by_room: list[list[tuple[np.ndarray, int]]] = [[] for _ in range(units + 1)]
    for t in np.flatnonzero(left)[::-1]:
        n, size = int(left[t]), int(t) + 1
        while n:
            room = next((r for r in range(size, units + 1) if by_room[r]), None)
            p, count = by_room[room].pop() if room is not None else (np.zeros_like(left), -(-n // (units // size)))
            room = units if room is None else room
            each = room // size          # a piece leaves the least room, so the next one follows it
            for k, some in ((each, min(count, n // each)), (n % each, 1)):
                if k and some and count and n:
                    q = p.copy()
                    q[t] += k
                    by_room[room - k * size].append((q, some))
                    n, count = n - k * some, count - some
            if count:
                by_room[room].append((p, count))
    return [(p, x) for same in by_room for p, x in same if p.any()]


def plan(demand: np.ndarray, units: int) -> Plan:
    """Patterns with whole counts that cover the demand exactly: the program's
    amounts rounded down, then best fit for the pieces they leave. With few
    pieces of many types the program ends far from its optimum and rounding loses
    most of it, so three plans are made, with all of its patterns, with the full
    ones and with none, and the one of the fewest sequences is taken."""
    kinds = np.arange(len(demand)) + 1
    patterns, amounts = solve_lp(demand.astype(float), units) if demand.any() else ([], [])
    plans = []
    for least in (0, int(units * (1 - 2 * GAP)), units + 1):
        left = demand.astype(np.int64).copy()
        some: list[tuple[np.ndarray, int]] = []
        for p, amount in zip(patterns, amounts):
            if not p.any() or (p * kinds).sum() < least:
                continue
            x = min(int(np.floor(amount + 1e-9)), int((left[p > 0] // p[p > 0]).min()))
            if x > 0:
                some.append((p, x))
                left -= p * x
        plans.append(some + best_fit(left, units))
    chosen = min(plans, key=lambda c: sum(x for _, x in c))
    upto, base, each = ([[] for _ in demand] for _ in range(3))
    first = 0
    for p, x in chosen:
        for t in np.flatnonzero(p):
            upto[t].append((upto[t][-1] if upto[t] else 0) + int(p[t]) * x)
            base[t].append(first)
            each[t].append(int(p[t]))
        first += x
    return Plan([np.array(u, np.int64) for u in upto], [np.array(b, np.int64) for b in base],
                [np.array(e, np.int64) for e in each], first)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """Pieces with ``sequence_id`` (gapless from 0) and ``offset``."""
    pieces = materialize(cut_documents(docs, path, capacity), "pieces")
    units = capacity // step
    kind = F.ceil(F.col("length") / step).cast("int") - 1
    hist = pieces.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most `units` rows
    demand = np.zeros(units, np.int64)
    for r in hist:
        demand[r["kind"]] = r["n"]
    demand[units - 1] = 0      # nothing fits beside a full piece
    todo = plan(demand, units)

    def place(batches):
        import pyarrow as pa
        for b in batches:
            kinds = b.column("kind").to_numpy()
            rank = b.column("rank").to_numpy()
            seq = np.empty(len(kinds), np.int64)
            order = np.argsort(kinds, kind="stable")
            at = np.searchsorted(kinds[order], np.arange(units + 1))
            for t in range(units):
                rows = order[at[t]:at[t + 1]]
                if not len(rows):
                    continue
                r = rank[rows]
                if t == units - 1:
                    seq[rows] = todo.sequences + r
                    continue
                k = np.searchsorted(todo.upto[t], r, "right")
                before = np.concatenate(([0], todo.upto[t]))[k]
                seq[rows] = todo.base[t][k] + (r - before) // todo.each[t][k]
            yield b.append_column("sequence_id", pa.array(seq))

    ranked = dense_rank_in(pieces.withColumn("kind", kind), "kind",
                           [F.col(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens", "row_key")])
    placed = ranked.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema)
                               + ", sequence_id long")
    # a sequence holds at most capacity/step... pieces, so its window is bounded
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank")
    return placed.withColumn("offset", (F.sum("length").over(order) - F.col("length")).cast("long")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed token ids, one row per sequence: ids (uint32, unpadded) with
    the lengths of its pieces, so a trainer can reset attention at each."""
    placed = pack(docs, path, capacity)
    ids = cut_documents(docs, path, capacity, with_ids=True).dropDuplicates(["doc_id", "start", "ids_crc32"])
    rows = placed.join(ids.select("doc_id", "start", "ids_crc32", "ids"), ["doc_id", "start", "ids_crc32"])
    part = F.struct("offset", "length", "doc_id", "ids")
    merged = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return merged.select("sequence_id", F.col("p.length").alias("lengths"), F.col("p.doc_id").alias("doc_ids"),
                         F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
