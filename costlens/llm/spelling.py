"""Spelling variants by one-edit neighbourhoods over a reduced alphabet.

1. Words are counted over all documents: a task adds up its own and hands out
   partial counts, so neither a frequent word nor a long text makes a hot task.
2. Letters are hashed to ``SYMBOLS`` symbols. Words that differ by one letter
   have reduced words that are equal or differ by one symbol, so a reduced word's
   neighbourhood (itself, each deletion, each replacement and each insertion of a
   symbol) is a few times its length instead of a whole alphabet's times that.
3. The neighbourhoods of the distinct reduced words are generated in full and
   joined to the reduced vocabulary, as 64-bit hashes. Most neighbours are no
   word; a bitmap of ``FILTER_BITS`` bits of the reduced vocabulary, whose size
   doesn't depend on the data, spares their shuffle. It lets through what it
   can't tell, so it affects the cost only.
4. Words whose reduced words met are compared as they are.
5. A word's form is its most frequent near word, if that is ``RATIO`` times as
   frequent. Forms are followed to the last one by pointer jumping: counts grow
   by that ratio with each step, so there is an end and it is near.

Null text has no words. A null ``doc_id`` counts as an empty string where ids are
part of a hash. Rows that repeat an id or a text count as often as they occur.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm.kernels import mix, powers
from costlens.session import materialize, share

#: Fixed values of the contract.
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
SLIP = 199

SYMBOLS = 8
#: Bits of the bitmap of reduced words (16 MB).
FILTER_BITS = 1 << 27
#: Words that a task counts before it hands out what it has.
HELD_WORDS = 200_000
#: Hashes of neighbours at once.
RUN_HASHES = 1 << 21

#: Runs of letters of the least length or more, lower-cased, as Latin-1; a run of
#: fewer letters is no word, whatever is deleted from it.
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LENGTH)

_CODE = np.arange(256, dtype=np.uint64)
SYMBOL_OF = (mix((_CODE + np.uint64(11)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SYMBOLS)).astype(np.int64)
_VALUE = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def words_in(doc_id, text: str | None, total: dict) -> None:
    """Add the words of a text to ``total``, with their slips."""
    from collections import Counter
    found = Counter(_RUN.findall((text or "").encode("latin-1", "replace").lower()))
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    crc = zlib.crc32
    for w, n in found.items():
        h = crc(w if w.isascii() else w.decode("latin-1").encode(), seed)
        if not h % SLIP:
            i = h % len(w)
            w = w[:i] + w[i + 1:]
            if len(w) < LEAST_LENGTH:
                continue
        total[w] = total.get(w, 0) + n


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words that occur often enough."""

    def run(batches):
        import pyarrow as pa

        def out(total):
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()),
                                               pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total: dict[bytes, int] = {}
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                words_in(doc_id, text, total)
                if len(total) >= HELD_WORDS:
                    yield out(total)
                    total.clear()
        yield out(total)

    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def by_length(words: list[str]):
    """For each length: (numbers of the words, their symbols [words, length])."""
    raw = [w.encode("latin-1") for w in words]
    size = np.array([len(w) for w in raw], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, SYMBOL_OF[np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), n)]


def _prefixes(symbols: np.ndarray) -> np.ndarray:
    """[words, length + 1]: the unfinished hash of each prefix."""
    up, _ = powers(symbols.shape[1] + 2)
    c = np.zeros((len(symbols), symbols.shape[1] + 1), np.uint64)
    np.cumsum(_VALUE[symbols] * up[:symbols.shape[1]], axis=1, out=c[:, 1:])
    return c


def _finish(h: np.ndarray, length: int) -> np.ndarray:
    return mix(h ^ np.uint64(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def reduced(words: list[str]) -> np.ndarray:
    """A hash of each reduced word."""
    out = np.zeros(len(words), np.uint64)
    for at, symbols in by_length(words):
        out[at] = _finish(_prefixes(symbols)[:, -1], symbols.shape[1])
    return out


def neighbourhoods(words: list[str]):
    """(number of the word, hash of a neighbour of its reduced word), each
    neighbour once, in runs of a bounded size."""
    for every, symbols in by_length(words):
        n = symbols.shape[1]
        up, down = powers(n + 2)
        step = max(1, RUN_HASHES // (2 * SYMBOLS * (n + 1)))
        for k in range(0, len(every), step):
            s, at = symbols[k:k + step], every[k:k + step]
            c = _prefixes(s)
            whole = c[:, -1:]
            less = c[:, :-1] + (whole - c[:, 1:]) * down[1]
            other = whole[:, :, None] + (_VALUE[None, None, :] - _VALUE[s][:, :, None]) * up[None, :n, None]
            more = (c + (whole - c) * up[1])[:, :, None] + _VALUE[None, None, :] * up[None, :n + 1, None]
            # a replacement by the same symbol is the reduced word itself
            h = np.concatenate([_finish(less, n - 1), _finish(other, n).reshape(len(s), -1),
                                _finish(more, n + 1).reshape(len(s), -1)], 1)
            h.sort(1)
            new = np.ones(h.shape, bool)
            new[:, 1:] = h[:, 1:] != h[:, :-1]
            yield np.repeat(at, new.sum(1)), h[new]


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys % np.uint64(FILTER_BITS)).astype(np.int64), ((keys >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


def bitmap(keys: DataFrame) -> np.ndarray:
    """The bitmap of the reduced words: 64 bits a row, added up by Spark."""

    def run(batches):
        import pyarrow as pa
        for b in batches:
            at = np.concatenate(_bits(b.column("r").to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> 6).astype(np.int32)), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))],
                names=["at", "bits"])

    rows = keys.select("r").mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def near_reduced(words: DataFrame) -> DataFrame:
    """(r, key): each reduced word and the neighbours that may be reduced words
    too, itself included. ``words`` is (word, n, r)."""
    # one word stands for all that reduce alike
    firsts = materialize(words.groupBy("r").agg(F.min("word").alias("word")), "reduced-words")
    get = share(words.sparkSession, bitmap(firsts))

    def run(batches):
        import pyarrow as pa
        held = get()
        for b in batches:
            r = b.column("r").to_numpy()
            for at, keys in neighbourhoods(b.column("word").to_pylist()):
                x, y = _bits(keys)
                ok = (held[x >> 6] >> (x & 63).astype(np.uint64)) & (held[y >> 6] >> (y & 63).astype(np.uint64)) & np.uint64(1) != 0
                yield pa.RecordBatch.from_arrays([pa.array(r[at[ok]]), pa.array(keys[ok].view(np.int64))], names=["r", "key"])

    return firsts.mapInArrow(run, "r long, key long")


def with_reduced(words: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("word"), b.column("n"), pa.array(reduced(b.column("word").to_pylist()).view(np.int64))],
                names=["word", "n", "r"])
    return words.mapInArrow(run, "word string, n long, r long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each word with each word one edit away."""
    other = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("r").alias("key"))
    met = words.join(near_reduced(words), "r").select("word", "n", "key")
    return met.join(other, (met["key"] == other["key"]) & (F.levenshtein("word", "near", 1) == 1)).select(
        "word", "n", "near", "near_n")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, root) links: the last of each chain."""
    links = materialize(forms, "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("to"))
        new = materialize(links.join(ahead, "root", "left").select(
            "word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        links = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return links


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the vocabulary."""
    words = materialize(with_reduced(vocabulary(docs)), "vocabulary")
    # most frequent first, and of those the least by code points
    near = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    out = words.select("word", "n").join(near, "word", "left")
    enough = -F.col("best.least") >= RATIO * F.col("n")
    out = materialize(out.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.least")).alias("form_n")), "variants")
    roots = followed(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return out.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
