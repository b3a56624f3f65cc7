"""Toxic spans and document scores by a linear-chain conditional random field.

Documents carry labels, tokens don't, so labelled tokens come first: counts of
hashed words over all training documents, equal texts once, say how much each
word leans to toxic documents, and a word far on that side marks its tokens in
toxic documents. That strength is a lower bound of the log odds ratio, which
more rows make surer but not greater; significance is only asked for. The field has two states; its features are the binned evidence of
a word and of its neighbours. It is fitted on a bounded sample of the training
rows, where a document's own share is taken out of the counts, so that words
seen nowhere else prove nothing. Forward-backward marginals of every token of every whole
text give the offending offsets, and their sum, maximum and density the
document's score by a logistic regression on the same sample.

Null and empty texts, and tables without labels, score the prior. Repeated
rows score alike. No column but the text enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm.kernels import byte_table, span_hashes, words_of
from costlens.llm.langid import held_out, separators
from costlens.session import materialize, share

BINS = 12
#: Bytes of a stem.
STEM = 6
#: Toxic documents that a word of the lexicon is in, at least.
LEAST_DOCS = 3
#: Signed root of the likelihood ratio statistic that a word needs at least.
SUPPORT = 2.0
#: Standard errors that the bound of a word's log odds ratio lies below it.
BELOW = 1.0
#: Strength from which a word marks a toxic document's token, and of a bin.
MARK = 1.5
STEP = 0.5
#: Documents that the field is fitted on, at most; taken by a hash of the id.
SAMPLE = 1000
#: Words of the pieces that the sample's whole texts are cut into for the fit.
PIECE = 64
SPAN_AT = 0.5


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes [2, words] of each word and of its first STEM bytes, so that the
    endings of a stem add up. Short words have one hash twice."""
    cut = np.minimum(ends, starts + STEM)
    stems = span_hashes(data, starts, cut, byte_table()) ^ np.uint64(STEM)
    return np.stack([words, np.where(ends - starts > STEM, stems, words)])


def word_counts(rows: DataFrame) -> DataFrame:
    """(h, bad, good): in how many toxic and other rows (toxic, text) each word
    and stem is. Every word is counted; a batch is summed before the shuffle."""

    def count(batches):
        import pyarrow as pa
        table, sep = byte_table(), separators()
        for b in batches:
            toxic = np.array(b.column("toxic").to_pylist(), dtype=np.int64)
            seen, label = [], []
            for i, data, o, s, e, h, w in words_of(b.column("text"), sep, table):
                doc = np.repeat(np.arange(len(o) - 1), np.diff(w))
                t = token_hashes(data, s, e, h).ravel()
                d = np.tile(doc, 2)
                order = np.lexsort((t, d))
                t, d = t[order], d[order]
                once = np.ones(len(t), bool)
                once[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
                seen.append(t[once])
                label.append(toxic[i:i + len(o) - 1][d[once]])
            if not seen:
                continue
            h, at = np.unique(np.concatenate(seen), return_inverse=True)
            y = np.concatenate(label)
            bad = np.bincount(at, y, len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.astype(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(h)) - bad)],
                names=["h", "bad", "good"])

    return rows.mapInArrow(count, "h long, bad long, good long").groupBy("h").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))


@dataclass
class Lexicon:
    """Words that lean to toxic documents, sorted by hash, with their counts."""
    h: np.ndarray
    bad: np.ndarray
    good: np.ndarray
    n_bad: int
    n_good: int

    def bins(self, tokens: np.ndarray, y: int | None = None) -> np.ndarray:
        """Bin of each token: the stronger of word and stem. With ``y`` the
        token's own document, of that label, is taken out of the counts."""
        if not len(self.h):
            return np.zeros(tokens.shape[1], np.int64)
        at = np.minimum(np.searchsorted(self.h, tokens), len(self.h) - 1)
        known = self.h[at] == tokens
        out = np.zeros(tokens.shape, np.int64)
        k = at[known]
        if y is None:
            out[known] = self.all[k]
        else:
            out[known] = bins_of(strength(self.bad[k] - y, self.good[k] - (1 - y), self.n_bad - y, self.n_good - (1 - y)))
        return out.max(0)

    def __post_init__(self):
        self.all = bins_of(strength(self.bad, self.good, self.n_bad, self.n_good))


def lexicon(labelled: DataFrame) -> Lexicon:
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)

    def leaning(batches):
        import pyarrow as pa
        for b in batches:
            x, y = (b.column(c).to_numpy() for c in ("bad", "good"))
            yield b.filter(pa.array(bins_of(strength(x, y, bad, good)) > 0))

    # every word that reaches a bin: 24 bytes each on the driver and in a task
    top = word_counts(labelled).where(F.col("bad") >= LEAST_DOCS).mapInArrow(leaning, "h long, bad long, good long").toArrow()
    h, x, y = (top.column(c).to_numpy() for c in ("h", "bad", "good"))
    h = h.astype(np.uint64)
    order = np.argsort(h)
    return Lexicon(h[order], x[order], y[order], bad, good)


def evidence(bad, good, n_bad, n_good) -> np.ndarray:
    """How surely a word leans to toxic documents (above zero) or to others:
    the signed root of the likelihood ratio statistic of word and label."""
    bad, good = np.maximum(bad, 0).astype(np.float64), np.maximum(good, 0).astype(np.float64)
    if n_bad <= 0 or n_good <= 0:
        return np.zeros(len(bad))
    share = (bad + good) / (n_bad + n_good)
    total = np.zeros(len(bad))
    for seen, n, p in ((bad, n_bad, share), (n_bad - bad, n_bad, 1 - share),
                       (good, n_good, share), (n_good - good, n_good, 1 - share)):
        total += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(n * p, 1e-9)), 0)
    return np.sign(bad / n_bad - good / n_good) * np.sqrt(np.maximum(2 * total, 0))


def strength(bad, good, n_bad, n_good) -> np.ndarray:
    """Lower bound of a word's log odds ratio of toxic against other rows, with
    half a row added to each count; zero where the evidence is too little."""
    bad, good = np.clip(bad, 0, max(n_bad, 0)).astype(np.float64), np.clip(good, 0, max(n_good, 0)).astype(np.float64)
    cells = [x + 0.5 for x in (bad, n_bad - bad, good, n_good - good)]
    odds = np.log(cells[0] / cells[1]) - np.log(cells[2] / cells[3])
    low = odds - BELOW * np.sqrt(sum(1 / x for x in cells))
    return np.where(evidence(bad, good, n_bad, n_good) >= SUPPORT, np.maximum(low, 0), 0)


def bins_of(lean: np.ndarray) -> np.ndarray:
    """No strength is bin 0; then steps of STEP, the last bin and beyond."""
    return np.clip(np.ceil(lean / STEP + 1e-9), 0, BINS - 1).astype(np.int64) * (lean > 0)


@dataclass
class Field:
    words: Lexicon
    own: np.ndarray         # [BINS] weight of state 1 by the word's bin
    side: np.ndarray        # [2, BINS] by the word before and after
    move: np.ndarray        # [2, 2] transitions
    begin: np.ndarray       # [2]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray     # of the document's features, bias last


def neighbours(b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the words before and after; at the edges the neutral bin."""
    before, after = np.empty_like(b), np.empty_like(b)
    before[1:], after[:-1] = b[:-1], b[1:]
    inside = np.unique(first[(first >= 0) & (first < len(b))])
    before[inside] = 0
    if len(b):
        after[inside[inside > 0] - 1] = 0
        after[-1] = 0
    return before, after


def forward_backward(score: np.ndarray, first: np.ndarray, move: np.ndarray, begin: np.ndarray):
    """Marginals of state 1, pair marginals summed to [2, 2] and the log
    partition of each text. ``score`` [words, 2]; all texts advance together."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, start = n[order], first[:-1][order]
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, longest + 1), "right")
    e = np.exp(np.clip(score - score.max(1, keepdims=True), -60, 0)) if len(score) else score
    m = np.exp(move)
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    norm = np.ones(len(e))
    for t in range(longest):
        rows = start[:active[t]] + t
        a = (np.exp(begin) if t == 0 else alpha[rows - 1] @ m) * e[rows]
        z = a.sum(1)
        alpha[rows], norm[rows] = a / z[:, None], z
    pair = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        rows = start[:active[t + 1]] + t
        nxt = e[rows + 1] * beta[rows + 1] / norm[rows + 1][:, None]
        pair += m * (alpha[rows].T @ nxt)
        beta[rows] = nxt @ m.T
    return alpha[:, 1] * beta[:, 1], pair, norm


def emissions(f: Field, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    before, after = neighbours(b, first)
    s = np.zeros((len(b), 2))
    s[:, 1] = f.own[b] + f.side[0][before] + f.side[1][after]
    return s


def fit_field(f: Field, b: np.ndarray, y: np.ndarray, first: np.ndarray, steps: int = 60) -> None:
    """Gradient ascent (Adam) on the conditional likelihood of all pieces."""
    first = np.unique(np.concatenate([first, *(np.arange(a, z, PIECE) for a, z in zip(first, first[1:]))]))
    before, after = neighbours(b, first)
    heads = first[:-1][np.diff(first) > 0]
    inner = np.ones(len(b), bool)
    inner[heads] = False
    at = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[at - 1], y[at]), 1)
    n = max(1, int(y.sum()))
    parts = [f.own, f.side[0], f.side[1], f.move, f.begin]
    m1, m2 = ([np.zeros_like(p) for p in parts] for _ in range(2))
    for k in range(1, steps + 1):
        p, pair, _ = forward_backward(emissions(f, b, first), first, f.move, f.begin)
        rest = y - p
        grads = [np.bincount(x, rest, BINS) for x in (b, before, after)]
        gone = float((y[heads] - p[heads]).sum())
        grads += [pairs - pair, np.array([-gone, gone])]
        for j, (x, g) in enumerate(zip(parts, grads)):
            g = g / n - 0.001 * x
            m1[j] = 0.9 * m1[j] + 0.1 * g
            m2[j] = 0.99 * m2[j] + 0.01 * g * g
            x += 0.3 * (m1[j] / (1 - 0.9 ** k)) / (np.sqrt(m2[j] / (1 - 0.99 ** k)) + 1e-8)


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum, maximum and density of the marginals of each text."""
    n = np.diff(first)
    out = np.zeros((len(n), 3))
    full = np.flatnonzero(n)
    if len(full):
        total = np.add.reduceat(p, first[:-1][full])
        out[full, 0] = np.log1p(total)
        out[full, 1] = np.maximum.reduceat(p, first[:-1][full])
        out[full, 2] = np.sqrt(total / n[full])
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 400):
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += 0.5 * (a.T @ (y - p) / len(y) - 0.001 * np.r_[w[:-1], 0])
    return mean, scale, w


#: Labelled ids up to which their table may be broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000


def _sample(docs: DataFrame, marks: DataFrame, words: Lexicon) -> DataFrame:
    """Binned words of at most SAMPLE rows, half of either label where there
    are as many; the choice is a hash of the id."""
    get = share(docs.sparkSession, words)
    halves = [marks.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE // 2)
              for c in (0, 1)]

    def run(batches):
        import pyarrow as pa
        words, table, sep = get(), byte_table(), separators()
        for b in batches:
            toxic = b.column("toxic").to_pylist()
            for i, data, o, s, e, h, w in words_of(b.column("text"), sep, table):
                t = token_hashes(data, s, e, h)
                k = len(o) - 1
                bins = [words.bins(t[:, w[d]:w[d + 1]], toxic[i + d]).astype(np.uint8).tobytes() for d in range(k)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("toxic").slice(i, k), pa.array(bins, pa.binary())], names=["toxic", "bins"])

    keys = F.broadcast(halves[0].unionByName(halves[1]))      # at most SAMPLE rows
    return docs.join(keys, "doc_id").select("toxic", F.col("text").cast("string").alias("text")).mapInArrow(
        run, "toxic int, bins binary")


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Word counts from all labelled rows; field and regression on a sample."""
    marks = materialize(labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
                        .select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct(), "labels")
    few = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    whole = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn(
        "row", F.xxhash64(F.col("text").isNull(), "text"))
    # equal texts of a label count once: the row of the least id
    rows = materialize(whole.join(F.broadcast(marks) if few else marks, "doc_id")
                       .groupBy("toxic", "row", "doc_id").agg(F.count(F.lit(1)).alias("k"))
                       .groupBy("toxic", "row").agg(F.sum("k").alias("rows"), F.min(F.struct("doc_id", "k")).alias("x"))
                       .select("toxic", "row", "rows", "x.doc_id", "x.k"), "labelled-texts")
    size = {r["toxic"]: r["rows"] for r in rows.groupBy("toxic").agg(F.sum("rows").alias("rows")).collect()}
    firsts = rows.select("doc_id", "row", "toxic")
    labelled = whole.join(F.broadcast(firsts) if few else firsts, ["doc_id", "row"]).select("toxic", "row", "text")
    if rows.where("k > 1").limit(1).count():
        labelled = labelled.dropDuplicates(["toxic", "row"])
    words = lexicon(labelled.drop("row"))
    f = Field(words, np.linspace(-3, 3, BINS), np.zeros((2, BINS)), np.array([[0.5, -0.5], [0.0, 0.0]]),
              np.array([0.0, -1.0]), np.zeros(3), np.ones(3), np.zeros(4))
    got = _sample(docs, marks, words).collect()
    if not got:
        return f
    got.sort(key=lambda r: (r["toxic"], bytes(r["bins"])))
    y = np.array([r["toxic"] for r in got])
    words = [np.frombuffer(r["bins"], np.uint8).astype(np.int64) for r in got]
    first = np.r_[0, np.cumsum([len(x) for x in words])]
    b = np.concatenate(words) if first[-1] else np.zeros(0, np.int64)
    marked = (b >= bins_of(np.array([MARK]))[0]) & np.repeat(y == 1, np.diff(first))
    if marked.any():
        fit_field(f, b, marked.astype(np.int64), first)
    p, _, _ = forward_backward(emissions(f, b, first), first, f.move, f.begin)
    f.mean, f.scale, f.weights = fit_logistic(document_features(p, first), y.astype(float))
    # the sample holds the labels in other shares than the training rows
    n, k = len(y), int(y.sum())
    if 0 < k < n:
        f.weights[-1] += np.log(size[1] / size[0]) - np.log(k / (n - k))
    return f


SCORE = ("doc_id long, score double, predicted int, n_spans int, "
         "spans array<struct<start:int,end:int>>")


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """Score, and byte offsets of the spans whose marginals reach SPAN_AT."""
    get = share(docs.sparkSession, field)

    def run(batches):
        import pyarrow as pa
        f, table, sep = get(), byte_table(), separators()
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for i, data, o, s, e, h, w in words_of(b.column("text"), sep, table):
                k = len(o) - 1
                x = f.words.bins(token_hashes(data, s, e, h))
                p, _, _ = forward_backward(emissions(f, x, w), w, f.move, f.begin)
                a = (document_features(p, w) - f.mean) / f.scale
                z = np.c_[a, np.ones(k)] @ f.weights
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                spans: list[list] = [[] for _ in range(k)]
                on = np.flatnonzero(p >= SPAN_AT)
                for t, d in zip(on, np.searchsorted(w, on, "right") - 1):
                    lo, hi = int(s[t] - o[d]), int(e[t] - o[d])
                    if spans[d] and t - 1 >= w[d] and p[t - 1] >= SPAN_AT:
                        spans[d][-1]["end"] = hi
                    else:
                        spans[d].append({"start": lo, "end": hi})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:i + k], pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                     pa.array([len(x) for x in spans], pa.int32()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=["doc_id", "score", "predicted", "n_spans", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, SCORE)


def toxicity_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = held_out(5, 0)
    field = train(docs.where(~out), labels.where(~out))
    return score_documents(docs, field).withColumn("held_out", out)
