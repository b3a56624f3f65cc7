"""Removal of repeated passages by run-length BWT indexes.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere
else in the corpus. The work is cut so that equal strings always meet:

1. Anchors: the ``GRAM``-byte gram of least hash inside each string of
   ``LENGTH`` bytes is its anchor. It depends on the string's bytes only, so
   equal strings have equal anchors. Consecutive strings with the same anchor
   are a segment of at most 2 * LENGTH bytes; only hashes and places of
   segments are shuffled.
2. Segments whose anchor occurs once hold nothing repeated and go. Equal
   segments collapse into one with a count; a counted one is repeated whole.
3. For anchors with different segments, these are read from the texts and
   dealt by anchor. Each task indexes them in blocks: suffix array,
   Burrows-Wheeler transform, its runs, and the common prefixes with the
   neighbours at run starts and run ends only. Elsewhere in the text they
   follow from the sample before, one less for each byte, so a pass over the
   text streams the matching statistics of every position, and positions that
   reach LENGTH start a repeated string.
4. Marked ranges go back to the documents by segment, so a passage that many
   documents share is indexed once.

An anchor with more than ``MOST`` different segments is not gathered in one
task: its strings are counted one by one by hash. Null text is empty; matches
never cross rows; rows equal in id and text are documents of their own (each
repeats the other). Documents are told apart by a 64-bit hash of id and text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm.kernels import byte_table, mix, powers, returning, runs, string_buffers
from costlens.session import materialize

LENGTH = 200
GRAM = 32
#: Bytes of texts, and of segments, that a task takes at once. Its arrays need about
#: 90 bytes for each of the first and 70 for each of the second.
RUN_BYTES = 1 << 18
BLOCK_BYTES = 1 << 20
MOST = 20_000
#: Rows of segments to read, and bytes of the merged spans, up to which the
#: list may be broadcast; beyond it the texts are shuffled to it.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20

SEGMENT = "anchor long, seg long, key long, start int, n int"


def _prefix_hash(data: np.ndarray):
    up, down = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_table(fold_ascii=False)[data] * up[:len(data)], out=c[1:])
    return c, down


def segments(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text number, anchor hash, segment hash, start, strings) of a run of
    texts; starts are counted within the run."""
    width = length - gram + 1
    n = len(data)
    if n < length:
        return [np.zeros(0, np.int64)] * 5
    c, down = _prefix_hash(data)
    m = n - gram + 1
    h = mix((c[gram:] - c[:m]) * down[:m])
    place = np.arange(m, dtype=np.uint64)
    low = np.uint64((1 << 24) - 1) if n <= 1 << 24 else np.uint64((1 << 31) - 1)
    key = (h & ~low) | place
    # least of each window by blocks: suffix minima of one and prefix minima
    # of the next
    full = -(-m // width) * width
    pad = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    pad[:m] = key
    grid = pad.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    last = n - length + 1
    at = (np.minimum(behind[:last], ahead[width - 1:width - 1 + last]) & low).astype(np.int64)
    # strings that lie in one text
    size = np.maximum(np.diff(off) - length + 1, 0)
    doc = np.repeat(np.arange(len(size)), size)
    s = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(off[:-1], size)
    if not len(s):
        return [np.zeros(0, np.int64)] * 5
    a = at[s]
    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])
    n_strings = np.diff(np.r_[cut, len(s)])
    start = s[cut]
    end = start + n_strings - 1 + length
    seg = mix(((c[end] - c[start]) * down[start]) ^ (n_strings.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return doc[cut], h[a[cut]].astype(np.int64), seg.astype(np.int64), start, n_strings


def with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("__key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text))


def segment_batches(batches):
    """The segments of the texts of Arrow batches (``__key``, ``text``)."""
    import pyarrow as pa
    for b in batches:
        raw, off = string_buffers(b.column("text"))
        keys = b.column("__key").to_numpy()
        for i, j in runs(off, RUN_BYTES):
            o = off[i:j + 1] - off[i]
            doc, anchor, seg, start, n = segments(raw[off[i]:off[j]], o)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor, pa.int64()), pa.array(seg, pa.int64()), pa.array(keys[i:j][doc], pa.int64()),
                 pa.array(start - o[doc], pa.int32()), pa.array(n, pa.int32())],
                names=["anchor", "seg", "key", "start", "n"])


def corpus_segments(keyed: DataFrame) -> DataFrame:
    return keyed.select("__key", F.col("text").cast("string").alias("text")).mapInArrow(
        lambda b: returning(segment_batches(b)), SEGMENT)


# ---- the index of one block (runs inside a task) ----

def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of all suffixes, each up to its segment's end; equal ones by
    place. ``text`` has symbols 1 to 256, ``left`` the symbols up to the end.
    Ranks are doubled, and a suffix whose rank is its own takes no further part."""
    n = len(text)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key <<= 9
        key[:n - j] |= np.where(left[:n - j] > j, text[j:], 0)
    order = np.argsort(key, kind="stable").astype(np.int32)
    slots = np.arange(n, dtype=np.int32)    # where the suffixes not yet told apart stand
    sorted_key = key[order]
    del key
    rank = np.zeros(n + 1, np.int32)        # the first slot of a suffix's group, from 1; 0 is the end
    depth, most = 7, int(left.max(initial=0))
    while len(slots):
        new = np.ones(len(slots), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(slots)])
        members = order[slots]
        rank[members] = np.repeat(slots[first] + 1, size)
        if depth >= most:
            break
        many = np.repeat(size > 1, size)
        del new, sorted_key
        slots, members = slots[many], members[many]
        key = rank[members].astype(np.int64) * (n + 2)
        key += np.where(left[members] > depth, rank[np.minimum(members + depth, n)], 0)
        again = np.argsort(key, kind="stable").astype(np.int32)
        order[slots] = members[again]
        sorted_key = key[again]
        del key
        depth *= 2
    return order


def common_prefix(words: np.ndarray, left: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes x and y; ``words`` pack seven
    symbols from each place."""
    out = np.zeros(len(x), np.int32)
    todo = np.arange(len(x), dtype=np.int32)
    most = np.minimum(left[x], left[y])
    n = len(words)
    while len(todo):
        a, b = x[todo] + out[todo], y[todo] + out[todo]
        inside = out[todo] < most[todo]
        diff = np.where(inside, words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)], 1 << 60)
        eq = np.full(len(todo), 7, np.int8)
        for k in range(7):
            eq[(diff >> (9 * (6 - k)) != 0) & (eq == 7)] = k
        out[todo] += eq
        todo = todo[(eq == 7) & (out[todo] < most[todo])]
    return np.minimum(out, most)


def matching_statistics(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """For every place of the concatenated parts: the longest match that
    starts there and at another place; where each part begins; BWT runs."""
    size = np.array([len(p) for p in parts], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    text = np.frombuffer(b"".join(parts), np.uint8).astype(np.int16) + np.int16(1)
    n = len(text)
    place = np.arange(n, dtype=np.int32)
    left = np.repeat(begin[1:].astype(np.int32), size) - place
    sa = suffix_array(text, left)
    words = np.zeros(n, np.int64)
    for j in range(7):
        words <<= 9
        words[:n - j] |= np.where(left[:n - j] > j, text[j:], 0)
    # the transform; a segment's first place has a symbol of its own, so a run
    # never joins two of them
    first = np.zeros(n, bool)
    first[begin[:-1][size > 0]] = True
    bwt = np.where(first[sa], -place - 1, text[sa - 1])
    head = np.ones(n, bool)                     # run starts
    head[1:] = bwt[1:] != bwt[:-1]
    del bwt
    tail = np.r_[head[1:], True]                # run ends
    stat = np.zeros(n, np.int32)
    for at, step in ((head, -1), (tail, 1)):
        i = np.flatnonzero(at)
        other = i + step
        ok = (other >= 0) & (other < n)
        value = np.zeros(len(i), np.int32)
        value[ok] = common_prefix(words, left, sa[i[ok]], sa[other[ok]])
        # every place takes the nearest sample before it, less the distance
        sample = np.full(n, -1, np.int32)
        sample[sa[i]] = value
        near = np.maximum.accumulate(np.where(sample >= 0, place, 0))
        stat = np.maximum(stat, np.maximum(sample[near], 0) - (place - near))
    return stat, begin, int(head.sum())


def repeated_ranges(on: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by strings that start where ``on`` is true."""
    i = np.flatnonzero(on)
    if not len(i):
        return []
    cut = np.flatnonzero(np.diff(i) > length)
    lo = i[np.r_[0, cut + 1]]
    hi = i[np.r_[cut, len(i) - 1]] + length
    return [(int(a), int(b)) for a, b in zip(lo, hi)]


RANGES = "array<struct<lo:int,hi:int>>"
FOUND = f"anchor long, seg long, ranges {RANGES}"


def _found_batch(rows):
    import pyarrow as pa
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([[{"lo": a, "hi": b} for a, b in r[2]] for r in rows], kind)], names=["anchor", "seg", "ranges"])


def index_segments(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Ranges repeated in other segments of the same anchor. ``texts``
    (anchor, seg, n, bytes) come sorted by anchor within partitions."""

    def run(batches):
        hold, size = [], 0

        def flush():
            stat, begin, _ = matching_statistics([x[3] for x in hold])
            rows = []
            for (anchor, seg, n, _), b in zip(hold, begin):
                r = repeated_ranges(stat[b:b + n] >= length, length)
                if r:
                    rows.append((anchor, seg, r))
            return rows

        for b in batches:
            c = b.to_pydict()
            for row in zip(c["anchor"], c["seg"], c["n"], c["bytes"]):
                if size >= BLOCK_BYTES and row[0] != hold[-1][0]:
                    if rows := flush():
                        yield _found_batch(rows)
                    hold, size = [], 0
                hold.append(row)
                size += len(row[3])
        if hold and (rows := flush()):
            yield _found_batch(rows)

    return texts.mapInArrow(lambda b: returning(run(b)), FOUND)


def count_strings(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same for anchors of very many segments: every string by its hash."""

    def strings(batches):
        import pyarrow as pa
        for b in batches:
            c = b.to_pydict()
            for anchor, seg, n, raw in zip(c["anchor"], c["seg"], c["n"], c["bytes"]):
                p, down = _prefix_hash(np.frombuffer(raw, np.uint8))
                h = mix((p[length:length + n] - p[:n]) * down[:n])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, anchor)), pa.array(np.full(n, seg)), pa.array(h.astype(np.int64)),
                     pa.array(np.arange(n, dtype=np.int32))], names=["anchor", "seg", "h", "at"])

    rows = texts.mapInArrow(lambda b: returning(strings(b)), "anchor long, seg long, h long, at int")
    again = rows.groupBy("anchor", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    places = rows.join(again, ["anchor", "h"], "left_semi").groupBy("anchor", "seg").agg(F.collect_list("at").alias("at"))

    def ranges(batches):
        for b in batches:
            c = b.to_pydict()
            out = []
            for anchor, seg, at in zip(c["anchor"], c["seg"], c["at"]):
                on = np.zeros(max(at) + 1, bool)
                on[at] = True
                out.append((anchor, seg, repeated_ranges(on, length)))
            yield _found_batch(out)

    return places.mapInArrow(lambda b: returning(ranges(b)), FOUND)


def segment_bytes(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of segments named by (key, start, n) in the texts."""
    lists = wanted.groupBy(F.col("key").alias("__key")).agg(
        F.collect_list(F.struct("start", "n", "anchor", "seg")).alias("parts"))    # bounded by the text
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def run(batches):
        import pyarrow as pa
        for b in batches:
            raw, off = string_buffers(b.column("text"))
            cols = ([], [], [], [])
            for o, parts in zip(off, b.column("parts").to_pylist()):
                for p in parts:
                    s = int(o) + p["start"]
                    for c, v in zip(cols, (p["anchor"], p["seg"], p["n"],
                                           raw[s:s + p["n"] + LENGTH - 1].tobytes())):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                 pa.array(cols[3], pa.binary())], names=["anchor", "seg", "n", "bytes"])

    texts = keyed.select("__key", F.col("text").cast("string").alias("text"))
    return (texts.join(F.broadcast(lists) if few else lists, "__key").select("text", "parts")
            .mapInArrow(lambda b: returning(run(b)), "anchor long, seg long, n int, bytes binary").dropDuplicates(["anchor", "seg"]))


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(key, spans): the byte ranges of each document that are repeated."""
    places = corpus_segments(keyed)
    again = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    cand = materialize(places.join(again, "anchor"), "repeated-segments")
    distinct = materialize(cand.groupBy("anchor", "seg").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "start", "n")).alias("at")), "distinct-segments")
    per = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("segs"), F.min("c").alias("least"))
    todo = materialize(distinct.join(per.where("segs > 1 AND least = 1"), "anchor")
                       .select("anchor", "seg", "c", "at.*", "segs"), "segments-to-index")
    texts = segment_bytes(keyed, todo.select("key", "start", "n", "anchor", "seg", "segs"))
    tagged = texts.join(todo.where(F.col("segs") > MOST).select("anchor").distinct().withColumn("hot", F.lit(1)),
                        "anchor", "left")
    tagged = materialize(tagged, "segment-bytes")
    plain = tagged.where("hot IS NULL").drop("hot")
    found = index_segments(plain.repartition("anchor").sortWithinPartitions("anchor", "seg"))
    if tagged.where("hot = 1").limit(1).count():
        found = found.unionByName(count_strings(tagged.where("hot = 1").drop("hot")))
    found = materialize(found, "repeated-ranges")
    whole = distinct.where("c > 1").select("anchor", "seg", F.array(F.struct(
        F.lit(0).alias("lo"), (F.col("at.n") + LENGTH - 1).cast("int").alias("hi"))).alias("ranges"))
    single = found.join(distinct.where("c = 1").select("anchor", "seg"), ["anchor", "seg"], "left_semi")
    marks = cand.join(whole.unionByName(single), ["anchor", "seg"]).select(
        "key", F.explode(F.transform("ranges", lambda r: F.struct(
            (F.col("start") + r["lo"]).alias("lo"), (F.col("start") + r["hi"]).alias("hi")))).alias("r"))
    listed = marks.groupBy("key").agg(F.collect_set("r").alias("spans"))     # bounded by the text
    return listed.mapInArrow(lambda b: returning(_merged(b)), "key long, spans binary")


def merge(spans: np.ndarray) -> np.ndarray:
    """Ranges [n, 2] as disjoint ones in order."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    far = np.maximum.accumulate(spans[:, 1])
    cut = np.flatnonzero(np.r_[True, spans[1:, 0] > far[:-1]])
    return np.stack([spans[cut, 0], far[np.r_[cut[1:], len(spans)] - 1]], 1)


def _merged(batches):
    import pyarrow as pa
    for b in batches:
        out = []
        for spans in b.column("spans"):
            v = spans.values
            out.append(merge(np.stack([v.field("lo").to_numpy(), v.field("hi").to_numpy()], 1)).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.binary())], names=["key", "spans"])


def unpack(spans: bytes | None) -> list[list[int]]:
    return np.frombuffer(spans or b"", "<i4").reshape(-1, 2).tolist()


def _with_spans(docs: DataFrame) -> DataFrame:
    keyed = with_key(docs)
    spans = materialize(repeated_spans(keyed).withColumnRenamed("key", "__key"), "spans")
    size = spans.agg(F.sum(F.octet_length("spans") + 64)).first()[0] or 0
    return keyed.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, "__key", "left")


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>"


def removal_digest(docs: DataFrame) -> DataFrame:
    """What goes from each document, with the hash of what stays."""

    def run(batches):
        import hashlib

        import pyarrow as pa
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            raw, off = string_buffers(b.column("text"))
            sizes, gone, digests, cuts = [], [], [], []
            for o, e, spans in zip(off, off[1:], b.column("spans").to_pylist()):
                m = unpack(spans)
                text = raw[o:e].tobytes()
                h, at = hashlib.sha256(), 0
                for x, y in m:
                    h.update(text[at:x])
                    at = y
                h.update(text[at:])
                sizes.append(len(text))
                gone.append(sum(y - x for x, y in m))
                digests.append(h.hexdigest())
                cuts.append([{"start": x, "end": y} for x, y in m])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array([len(c) for c in cuts], pa.int64()), pa.array(digests), pa.array(cuts, kind)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_spans(slim).select("doc_id", "text", "spans").mapInArrow(
        lambda b: returning(run(b)), DIGEST)


def without_repeats(docs: DataFrame) -> DataFrame:
    """Documents with repeated passages cut out; a character that loses a byte
    goes whole. Documents of which nothing but white space is left, though
    they had more, go; ``n_chars`` is counted anew where text went."""
    fields = docs.schema

    def run(batches):
        import pyarrow as pa
        for b in batches:
            texts = b.column("text").to_pylist()
            spans = b.column("spans").to_pylist()
            keep = [True] * len(texts)
            for i, s in enumerate(spans):
                if s:
                    raw, at, out = texts[i].encode(), 0, []
                    for x, y in unpack(s):
                        out.append(raw[at:x].decode(errors="ignore"))
                        at = y
                    out.append(raw[at:].decode(errors="ignore"))
                    texts[i] = "".join(out)
                    keep[i] = bool(texts[i].strip())
            cols = []
            for f in fields:
                col = b.column(f.name)
                if f.name == "text":
                    col = pa.array(texts, pa.string())
                elif f.name == "n_chars":
                    col = pa.array([len(t) if s else v for t, s, v in zip(texts, spans, col.to_pylist())], col.type)
                cols.append(col)
            yield pa.RecordBatch.from_arrays(cols, names=fields.names).filter(pa.array(keep))

    return _with_spans(docs).select(*[F.col(c) for c in fields.names], "spans").mapInArrow(
        lambda b: returning(run(b)), fields)
