"""Language identification with spans of mixed-language text.

Training counts hashed byte n-grams of words (1 to 4 bytes and whole words)
for each language over all training rows. A word's script, from the lead
bytes of its letters, leaves the languages that use that script as
candidates; a Viterbi pass over the per-word scores, where changing the
language costs ``SWITCH``, labels every word, and runs of one label are spans.
A document's language is the one with most letter bytes, ties to the name that
sorts first.

A null text, or one without a letter, is ``und`` with score 0. With no training
rows every text is ``und``. Very long texts are labelled whole. Repeated rows
are labelled alike; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm import counts
from costlens.llm.kernels import RUN_BYTES, byte_table, mix, returning, runs, span_hashes, string_buffers, word_bounds
from costlens.session import share

BITS = 16
SWITCH = 6.0
#: Words scored at once, and bytes of texts counted at once: the arrays of their n-grams
#: need some 200 bytes for each byte of text.
WORDS = 1 << 15
TRAIN_BYTES = 1 << 18
#: A language is a candidate for a script that holds this share of its words.
SCRIPT_SHARE = 0.01

# Scripts by UTF-8 lead byte (0 neutral, 1 Latin, 2 Greek,
# 3 Cyrillic, 4 Hebrew, 5 Arabic, 6 Indic and other Brahmic, 7 kana and Han,
# 8 Hangul, 9 other).
SCRIPTS = 10
_LEADS = [(0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xCB, 1), (0xCD, 0xCF, 2), (0xD0, 0xD4, 3),
          (0xD6, 0xD7, 4), (0xD8, 0xDB, 5), (0xE0, 0xE0, 6), (0xE1, 0xE1, 9), (0xE3, 0xE9, 7),
          (0xEA, 0xED, 8), (0xEF, 0xF4, 9)]


def script_table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for a, b, s in _LEADS:
        t[a:b + 1] = s
    return t


#: Words are runs of letters; every byte of a multi-byte character counts.
def separators() -> np.ndarray:
    sep = np.ones(256, bool)
    sep[65:91] = sep[97:123] = sep[128:] = False
    return sep


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray):
    """(bucket, word number) of each word's n-grams, n from 1 to 4, with the
    word's edges, and of the word itself."""
    lens = ends - starts
    word = np.repeat(np.arange(len(starts)), lens)
    at = np.arange(len(word)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(starts, lens)
    v = table[data[at]]
    first, last = at == starts[word], at == ends[word] - 1
    edge = np.uint64(0x51ED270B)
    prev = np.where(first, edge, np.roll(v, 1))
    prev2 = np.where(first, edge, np.roll(prev, 1))
    prev3 = np.where(first | np.roll(first, 1), edge, np.roll(prev2, 1))
    shift = np.uint64(64 - BITS)
    tri = ((prev2 * np.uint64(31) + prev) * np.uint64(0x9E3779B97F4A7C15) + v) * np.uint64(0xD6E8FEB86659FD93) >> shift
    quad = (((prev3 * np.uint64(37) + prev2) * np.uint64(0xBF58476D1CE4E5B9) + prev)
            * np.uint64(0x94D049BB133111EB) + v) * np.uint64(0x2545F4914F6CDD1D) >> shift
    tail = (prev * np.uint64(0xFF51AFD7ED558CCD) + v) * np.uint64(0xC4CEB9FE1A85EC53) >> shift
    whole = mix(span_hashes(data, starts, ends, table)) >> shift
    return tri, quad, np.where(last, tail, tri), whole, word


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray        # [2**BITS, languages], float32
    allowed: np.ndarray     # [SCRIPTS, languages]


def _per_run(col, table, sep, limit: int = RUN_BYTES):
    raw, off = string_buffers(col)
    for i, j in runs(off, limit):
        data, o = raw[off[i]:off[j]], off[i:j + 1] - off[i]
        s, e = word_bounds(data, o, sep)
        yield i, data, o, s, e, np.searchsorted(s, o)


def train(rows: DataFrame) -> Model:
    """Counts over all ``rows`` (text, lang); null languages are left out."""
    size = 1 << BITS

    def count(batches):
        table, sep, script = byte_table(), separators(), script_table()
        grams: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            for i, data, o, s, e, w in _per_run(b.column("text"), table, sep, TRAIN_BYTES):
                if not len(s):
                    continue
                tri, quad, tail, whole, word = features(data, s, e, table)
                doc = np.repeat(np.arange(len(o) - 1), np.diff(w))
                kind = np.maximum.reduceat(script[data], s)
                mine = langs[i:i + len(o) - 1]
                for lang in set(mine):
                    t = grams.setdefault(lang, np.zeros(size + counts.BLOCK, np.int64))
                    pick = (mine == lang)[doc]
                    on = pick[word]
                    for f in (tri[on], quad[on], tail[on], whole[pick]):
                        t[:size] += np.bincount(f.astype(np.int64), minlength=size)
                    t[size:size + SCRIPTS] += np.bincount(kind[pick], minlength=SCRIPTS)
        yield from counts.emit(grams)

    labelled = rows.where(F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    tables = counts.collect_tables(counts.add_up(labelled.mapInArrow(lambda b: returning(count(b)), counts.FIELDS)), size + counts.BLOCK)
    langs = sorted(tables)
    if not langs:
        return Model([], np.zeros((size, 0), np.float32), np.zeros((SCRIPTS, 0), bool))
    n = np.stack([tables[k][:size] for k in langs], 1).astype(np.float64)
    alpha = 0.5
    logp = np.log((n + alpha) / (n.sum(0) + alpha * size))
    logp -= logp.mean(1, keepdims=True)
    s = np.stack([tables[k][size:size + SCRIPTS] for k in langs], 1).astype(np.float64)
    allowed = s >= SCRIPT_SHARE * np.maximum(s.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return Model(langs, logp.astype(np.float32), allowed)


def word_scores(model: Model, data, starts, ends, table, script) -> np.ndarray:
    """Scores [words, languages]; languages that don't use the word's script
    are set far behind the others."""
    tri, quad, tail, whole, word = features(data, starts, ends, table)
    edges = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    per_byte = model.logp[tri] + model.logp[quad] + model.logp[tail]
    out = np.add.reduceat(per_byte, edges, axis=0) + 2 * model.logp[whole]
    kind = np.maximum.reduceat(script[data], starts)
    return np.where(model.allowed[kind], out * 0.4, -1e4)


def run_scores(model: Model, data, starts, ends, table, script, words: int = WORDS) -> np.ndarray:
    """The same for all words of a run, some at a time."""
    out = np.empty((len(starts), len(model.langs)), model.logp.dtype)
    for k in range(0, len(starts), words):
        s, e = starts[k:k + words], ends[k:k + words]
        out[k:k + words] = word_scores(model, data[s[0]:e[-1]], s - s[0], e - s[0], table, script)
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; ``first`` are the texts' first words. All
    texts advance together, one word at a time."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, start = n[order], first[:-1][order]
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, longest + 1), "right")
    labels = np.zeros(len(scores), np.int16)
    came = np.zeros(len(scores), np.int16)        # the state before a switch
    stay = np.zeros(scores.shape, bool)
    v = np.zeros((len(n), scores.shape[1]), np.float32)
    for t in range(longest):
        a = active[t]
        rows = start[:a] + t
        cur = v[:a]
        if t:
            top = cur.argmax(1)
            away = cur[np.arange(a), top] - switch
            keep = cur >= away[:, None]
            came[rows], stay[rows] = top, keep
            cur = np.where(keep, cur, away[:, None])
        v[:a] = cur + scores[rows]
    now = v.argmax(1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        rows = start[:a] + t
        labels[rows] = now[:a]
        if t:
            kept = stay[rows, now[:a]]
            now[:a] = np.where(kept, now[:a], came[rows])
    return labels


SPANS = "array<struct<start:int,end:int,lang:string>>"


def label_texts(model: Model, texts):
    """For each run of an Arrow column: (first text, languages, scores, spans)."""
    table, sep, script = byte_table(), separators(), script_table()
    langs = model.langs
    for i, data, o, s, e, w in _per_run(texts, table, sep):
        k = len(o) - 1
        pred, score = ["und"] * k, [0.0] * k
        spans: list[list] = [[] for _ in range(k)]
        if len(s) and langs:
            labels = viterbi(run_scores(model, data, s, e, table, script), w)
            doc = np.repeat(np.arange(k), np.diff(w))
            weight = np.bincount(doc * len(langs) + labels, e - s, k * len(langs)).reshape(k, -1)
            best, total = weight.argmax(1), weight.sum(1)
            ascii_letters = np.concatenate(([0], np.cumsum((script[data] == 1) & (data < 128))))
            plain = ascii_letters[o[1:]] > ascii_letters[o[:-1]]
            for d in np.flatnonzero(total):
                if plain[d] or has_letter(texts[i + int(d)].as_py()):
                    pred[d] = langs[best[d]]
                    score[d] = float(weight[d, best[d]] / total[d])
            cut = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])])
            end = np.r_[cut[1:], len(labels)] - 1
            for x, y in zip(cut, end):
                d = doc[x]
                if pred[d] != "und":
                    spans[d].append({"start": int(s[x] - o[d]), "end": int(e[y] - o[d]), "lang": langs[labels[x]]})
        yield i, pred, score, spans


def identify(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """One row per document: language, share of its letter bytes, and spans
    (byte offsets) of one language each."""
    get = share(docs.sparkSession, model)
    kind = [("start", "int32"), ("end", "int32"), ("lang", "string")]

    def run(batches):
        import pyarrow as pa
        spans_type = pa.list_(pa.struct([(n, getattr(pa, t)()) for n, t in kind]))
        model = get()
        for b in batches:
            ids = b.column("doc_id")
            for i, pred, score, spans in label_texts(model, b.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, len(pred)), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                     pa.array([len(x) for x in spans], pa.int32()),
                     pa.array(spans if with_spans else [None] * len(spans), spans_type)],
                    names=["doc_id", "lang_pred", "score", "n_spans", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, f"doc_id long, lang_pred string, score double, n_spans int, spans {SPANS}")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, every column as it was, that have a language. A model
    of no language at all (no labelled row) knows letters only: texts without one
    go, and nothing else does."""
    get = share(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa
        model = get()
        for b in batches:
            if model.langs:
                keep = [p != "und" for _, labels, _, _ in label_texts(model, b.column(at)) for p in labels]
            else:
                keep = [t is not None and has_letter(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lambda b: returning(run(b)), docs.schema)


def held_out(mod: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def language_of_documents(docs: DataFrame, with_spans: bool = False) -> DataFrame:
    """Learn from the rows that are not held out, predict every row."""
    out = held_out(4, 2)
    model = train(docs.where(~out).select("text", "lang"))
    return identify(docs, model, with_spans).withColumn("held_out", out)


def identified_documents(docs: DataFrame) -> DataFrame:
    """The documents that have a language; learned as in the query above."""
    return keep_identified(docs, train(docs.where(~held_out(4, 2)).select("text", "lang")))
