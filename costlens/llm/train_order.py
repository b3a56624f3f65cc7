"""Training-order materialisation of token sequences.

1. Documents are tokenised once, end in an end token and are written as a table.
   A task numbers the sequences of ``stride`` ids that its documents are cut into,
   so a document knows its first number within its part.
2. The parts' counts, one row each, become running sums: every sequence has a dense
   number in [0, N) without a sort.
3. A keyed Feistel network over [0, N), with cycle-walking back into it, turns the
   number into the sequence's global slot. Slot, shard and record follow from the
   number alone: nothing is counted or ranked after the permutation.
4. Sequences go to the partition of their shard, one shard a task, are put in the
   order of their records and written as a file of fixed-stride records (padded).
   The shards are written in ``PASSES`` jobs over the table of ids, so that only a
   part of the sequences lies in the shuffle beside the table and the shards. Hence
   record i of a shard is at byte ``i * stride * width`` and training resumes
   from a global slot alone, also in the middle of a shard.

Ids take two bytes, or four where the vocabulary needs them. Null text is an empty
text and gives one sequence with the end token; a null id and repeated rows are
documents like others; an empty table writes no shard. Files are written under a
name of the attempt and renamed, so a lost or repeated task leaves whole files only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costlens.llm.tokens import encode_texts, runs_of, tokenizer_path
from costlens.session import checkpoint_dir, materialize, shuffles_dropped

STRIDE = 512
END_ID = 49407      # <|endoftext|> of word_bpe_49k
SHARD_BYTES = 64 << 20
ROUNDS = 6
PASSES = 3          # jobs that write the shards: each shuffles its share of the sequences
_MUL = np.uint64(0x9E3779B97F4A7C15)


def id_width(path: str, end_id: int = END_ID) -> int:
    """Bytes of an id: two, if the ids and the padding, which is the greatest
    value, fit into them, else four."""
    from tokenizers import Tokenizer
    most = max(end_id, *Tokenizer.from_file(path).get_vocab().values())
    return 2 if most < 0xFFFF else 4


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * _MUL
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def feistel(x: np.ndarray, domain: int, key: int, back: bool = False) -> np.ndarray:
    """The permutation of [0, domain) of ``key`` (``back``: its inverse)."""
    if not 0 < domain <= 1 << 62:
        raise ValueError("the domain must have 1 to 2**62 values")
    half = max(1, -(-(domain - 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [(key * 0x100000001B3 + r * 0x9E3779B97F4A7C15) % (1 << 64) for r in range(ROUNDS)]

    def once(v):
        left, right = v >> shift, v & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (_scramble(left, k) & mask), left
            else:
                left, right = right, left ^ (_scramble(right, k) & mask)
        return (left << shift) | right

    out = once(np.asarray(x, np.uint64))
    while (away := out >= np.uint64(domain)).any():     # cycle-walking
        out[away] = once(out[away])
    return out


DOC = "part int, first long, n_seqs long, doc_id long, ids binary"


def tokenised(docs: DataFrame, stride: int, width: int, path: str, end_id: int) -> DataFrame:
    """One row per document: its part, its first sequence number there, its number
    of sequences and its ids."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, first = TaskContext.get().partitionId(), 0
        kind = f"<u{width}"
        end = np.array([end_id], kind).tobytes()
        for b in batches:
            texts = b.column("text").fill_null("").to_pylist()
            ids = b.column("doc_id")
            for lo, hi in runs_of(texts):
                got = [np.frombuffer(e, "<u4").astype(kind).tobytes() + end for e in encode_texts(texts[lo:hi], path)]
                n = -(-np.array([len(x) for x in got], np.int64) // (width * stride))
                start = first + np.cumsum(n) - n
                first += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(got), part, np.int32)), pa.array(start), pa.array(n), ids.slice(lo, len(got)),
                     pa.array(got, pa.binary())], names=["part", "first", "n_seqs", "doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, DOC)


SEQUENCE = "doc_id long, seq long, number long, slot long, shard int, record long, n_tokens int, ids binary"
RECORD = "doc_id long, seq long, number long, slot long, shard int, record long, n_tokens int, ids_crc32 long"


def sequences(docs: DataFrame, total: int, records: int, key: int, stride: int, width: int,
              low: int, high: int) -> DataFrame:
    """The sequences of documents (doc_id, n_seqs, ids, base: the first dense
    number) in the shards from ``low`` to before ``high``, with slot, shard and
    record."""

    def run(batches):
        import pyarrow as pa
        step = stride * width
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                some = b.slice(lo, 128)
                n = some.column("n_seqs").to_numpy()
                doc = np.repeat(np.arange(len(n)), n)
                seq = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                number = some.column("base").to_numpy()[doc] + seq
                slot = feistel(number, total, key).astype(np.int64)
                here = np.flatnonzero((slot // records >= low) & (slot // records < high))
                doc, seq, number, slot = doc[here], seq[here], number[here], slot[here]
                whole = some.column("ids").to_pylist()
                ids = [whole[d][k:k + step] for d, k in zip(doc.tolist(), (seq * step).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(doc)), pa.array(seq), pa.array(number), pa.array(slot),
                     pa.array((slot // records).astype(np.int32)), pa.array(slot % records),
                     pa.array([len(x) // width for x in ids], pa.int32()), pa.array(ids, pa.binary())],
                    names=[x.split()[0] for x in SEQUENCE.split(", ")])

    return docs.select("doc_id", "n_seqs", "ids", "base").mapInArrow(run, SEQUENCE)


def write_training_order(docs: DataFrame, out: str, key: int = 17, stride: int = STRIDE, shard_bytes: int = SHARD_BYTES,
                         path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the shards below ``out`` (any URI that ``pyarrow.fs`` opens) and
    return the manifest: one row per sequence with shard, record and slot."""
    path = path or tokenizer_path()
    width = id_width(path, end_id)
    records = max(1, shard_bytes // (stride * width))
    # ids are dense: the slower codec saves a good part of the table
    held = materialize(tokenised(docs, stride, width, path, end_id), "token-ids", compression="zstd")
    counts = materialize(held.groupBy("part").agg(F.sum("n_seqs").alias("n")), "part-counts")    # one row per part
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    base = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = held.join(base, "part").select("doc_id", "n_seqs", "ids", (F.col("before") + F.col("first")).alias("base"))
    shards = max(1, -(-total // records))

    def write(batches):
        import os
        import zlib

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext
        place, root = fs.FileSystem.from_uri(out)
        place.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        pad = b"\xff" * width
        now, sink, temp = None, None, None

        def close():
            if sink is not None:
                sink.close()
                place.move(temp, f"{root}/shard-{now:06d}.bin")

        for b in batches:
            parts = []
            for shard, ids in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist()):
                if shard != now:
                    if parts:
                        sink.write(b"".join(parts))
                        parts = []
                    close()
                    now, temp = shard, f"{root}/.shard-{shard:06d}-{attempt}-{os.getpid()}"
                    sink = place.open_output_stream(temp, compression=None)
                parts.append(ids + pad * (stride - len(ids) // width))
            if parts:
                sink.write(b"".join(parts))
            crc = pa.array([zlib.crc32(x) for x in b.column("ids").to_pylist()], pa.int64())
            yield b.drop_columns(["ids"]).append_column("ids_crc32", crc)
        close()

    def one_pass(low, high):
        # a shard is a partition: slots are evenly spread, so shards are of one size
        seqs = sequences(numbered, max(total, 1), records, key, stride, width, low, high)
        dealt = seqs.repartitionById(high - low, F.col("shard") - low).sortWithinPartitions("shard", "record")
        with shuffles_dropped(docs.sparkSession):
            return materialize(dealt.mapInArrow(write, RECORD), "training-order")

    step = -(-shards // PASSES)
    return reduce(DataFrame.unionAll, [one_pass(lo, min(lo + step, shards)) for lo in range(0, shards, step)])


def read_slots(manifest: DataFrame, out: str, stride: int = STRIDE, width: int = 2) -> DataFrame:
    """Manifest rows with ``ids`` read back from their shard's fixed offsets."""

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs
        place, root = fs.FileSystem.from_uri(out)
        now, f = None, None
        for b in batches:
            got = []
            for sh, r, n in zip(*(b.column(c).to_pylist() for c in ("shard", "record", "n_tokens"))):
                if sh != now:
                    now, f = sh, place.open_input_file(f"{root}/shard-{sh:06d}.bin")
                got.append(f.read_at(width * n, r * stride * width))
            yield b.append_column("ids", pa.array(got, pa.binary()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in manifest.schema)
    return (manifest.repartitionByRange("shard", "record").sortWithinPartitions("shard", "record")
            .mapInArrow(read, fields + ", ids binary"))


def resume(out: str, slot: int, shard_bytes: int = SHARD_BYTES, stride: int = STRIDE, width: int = 2):
    """The records from a global slot on, as arrays of ``stride`` ids with their
    padding: what a training process reads, sequentially and without a manifest."""
    from pyarrow import fs
    place, root = fs.FileSystem.from_uri(out)
    records = max(1, shard_bytes // (stride * width))
    while True:
        shard, record = divmod(slot, records)
        name = f"{root}/shard-{shard:06d}.bin"
        if place.get_file_info(name).type == fs.FileType.NotFound:
            return
        with place.open_input_stream(name, compression=None) as f:
            f.seek(record * stride * width) if f.seekable() else f.read(record * stride * width)
            while raw := f.read(stride * width):
                yield np.frombuffer(raw, f"<u{width}")
                slot += 1
        if slot % records:
            return


def scratch_uri(spark, name: str) -> str:
    """A new folder of the cluster's shared checkpoint folder, as a URI."""
    import uuid
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/{name}-{uuid.uuid4().hex}"
