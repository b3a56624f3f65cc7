"""What the tasks of the pipeline's stages hold in Python for each byte of text,
and that cutting the work smaller changes no result."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from costlens.llm import langid, rindex
from costlens.llm.kernels import runs, string_buffers

MB = 1 << 20


@pytest.fixture(scope="module")
def texts():
    """A megabyte of texts of random words."""
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 10, 3000)]
    return [" ".join(words[i] for i in rng.integers(0, 3000, n)) for n in rng.integers(100, 900, 330)]


def peak(fn) -> int:
    fn()                    # tables that a process makes once
    tracemalloc.start()
    try:
        fn()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_segments_of_a_batch_take_bounded_memory(texts):
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["__key", "text"])
    assert MB // 2 < batch.nbytes < 2 * MB

    def run():
        for _ in rindex.segment_batches([batch]):
            pass

    assert peak(run) < 40 * MB


def test_index_takes_bounded_memory(texts):
    parts = [t[k:k + 370].encode() for t in texts for k in range(0, len(t), 370)]
    size = sum(map(len, parts))
    assert peak(lambda: rindex.matching_statistics(parts)) < 75 * size


def test_language_scores_take_bounded_memory_and_are_the_same(texts):
    rng = np.random.default_rng(4)
    langs = [f"l{i}" for i in range(10)]
    model = langid.Model(langs, rng.random((1 << langid.BITS, 10), np.float32), rng.random((langid.SCRIPTS, 10)) > 0.2)
    col = pa.array(texts)

    def run():
        for _ in langid.label_texts(model, col):
            pass

    assert peak(run) < 70 * MB
    table, sep, script = langid.byte_table(), langid.separators(), langid.script_table()
    _, data, _, s, e, _ = next(langid._per_run(pa.array([*texts[:9], "ünï αβ x", "да"]), table, sep))
    whole = langid.word_scores(model, data, s, e, table, script)
    for words in (1, 7, 1000, len(s)):
        assert np.array_equal(whole, langid.run_scores(model, data, s, e, table, script, words))


def test_segments_do_not_depend_on_the_cut_of_a_batch(texts):
    some = [*texts[:40], "", None, "x" * 500, texts[0], "y" * 199, "z" * 200]
    raw, off = string_buffers(pa.array(some))
    got = {}
    for limit in (1, 5000, MB):
        rows = []
        for i, j in runs(off, limit):
            o = off[i:j + 1] - off[i]
            doc, anchor, seg, start, n = rindex.segments(raw[off[i]:off[j]], o)
            rows += zip((doc + i).tolist(), anchor.tolist(), seg.tolist(), (start - o[doc]).tolist(), n.tolist())
        got[limit] = rows
    assert got[1] == got[5000] == got[MB]
    assert len(got[1]) > 100
