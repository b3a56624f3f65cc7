"""Token ids of whole texts by an installed tokenizer, inside Spark tasks.

``word_bpe_49k`` splits at white space before anything else, so the ids of a
text are those of its blank-separated chunks in order. Chunks repeat: those of
many texts are coded by their distinct values in Arrow, each task's process
keeps a bounded cache from chunk to ids, and only unseen chunks are encoded.
Unseen chunks of plain letters, digits and marks are cut as the tokenizer cuts
them and go to its model at once; all others go through the whole tokenizer.
Tests hold the result against ``encode``.
"""

from __future__ import annotations

import os
import re

#: Chunks that a worker process keeps at most (about 100 MB).
CACHE_CHUNKS = 400_000

#: Characters of the texts that are split at once (a longer text: alone).
RUN_CHARS = 4_000_000

_HIGH = re.compile("[^\x00-ɏ]")
_LOADED: dict[str, tuple] = {}
_MODELS: dict[str, tuple | None] = {}

#: Marks that end a chunk after a plain letter are a piece of their own; parting
#: them makes chunks repeat more often. Special strings end in ``>``.
_TAIL = r"([a-zß-öø-ÿ])([!-&(-/:-=?@\[-`{-~]+)( |$)"

#: Lower-case letters, digits and marks whose chunks are cut here: NFC and
#: lower-casing leave them as they are. Without the apostrophe, which begins
#: the tokenizer's contractions.
_PLAIN = re.compile(r"[a-zß-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
_WORD = re.compile("[a-zß-öø-ÿ]+")
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: The tokenizer's steps before its model that ``_PIECES`` stands for.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = ({"type": "Sequence", "normalizers": [
              {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
          {"type": "Sequence", "pretokenizers": [
              {"type": "Split", "pattern": {"Regex": _CUT}, "behavior": "Removed", "invert": True},
              {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _load(path: str):
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        _LOADED[path] = (tok, {"": b""}, _separator(tok))
    return _LOADED[path]


def _model(path: str):
    """The tokenizer's model and the pairs of bytes of a letter beyond ASCII that it
    names unlike Latin-1; None for a tokenizer with other steps before its model."""
    if path not in _MODELS:
        import json

        from tokenizers import pre_tokenizers
        tok = _load(path)[0]
        steps = tuple(x and json.loads(x.__getstate__()) for x in (tok.normalizer, tok.pre_tokenizer))
        _MODELS[path] = None
        if steps == _STEPS:
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            names = [(c.encode().decode("latin-1"), level.pre_tokenize_str(c)[0][0]) for c in map(chr, range(0xDF, 0x100))]
            _MODELS[path] = (tok.model, [(a, b) for a, b in names if a != b])
    return _MODELS[path]


def lowered(text: str) -> str:
    """Lower-casing letter by letter is the tokenizer's own first step but for
    its special strings; texts with letters beyond U+024F are left to it too, as
    Python lower-cases some of those by context."""
    return text if "<|" in text or not text.isascii() and _HIGH.search(text) else text.lower()


#: Chunks that are encoded as one text.
JOINED = 400


def _separator(tok) -> tuple[str, int] | None:
    """A word of one id that no chunk is likely to hold: the last whole word of
    the vocabulary."""
    words = tok.get_vocab()
    for w, i in sorted(((w, i) for w, i in words.items() if w.endswith("</w>")), key=lambda x: -x[1])[:200]:
        plain = w.removesuffix("</w>")
        if plain.isascii() and plain.isalpha() and tok.encode(plain, add_special_tokens=False).ids == [i]:
            return plain, i
    return None


def _encode_chunks(tok, separator, chunks: list[str]) -> list[bytes]:
    """The ids of each chunk. Hundreds of chunks are one text to the tokenizer,
    with a word between them at whose id the result is cut; where that word's id
    isn't found just between them, chunks are encoded one by one."""
    import numpy as np

    out: list[bytes] = []
    for k in range(0, len(chunks), JOINED):
        some = chunks[k:k + JOINED]
        if separator is not None:
            word, mark = separator
            ids = np.array(tok.encode(f" {word} ".join(some), add_special_tokens=False).ids, "<u4")
            at = np.flatnonzero(ids == mark)
            if len(at) == len(some) - 1:
                raw = ids.tobytes()
                ends = [*(4 * at).tolist(), len(raw)]
                starts = [0, *(4 * at + 4).tolist()]
                out += [raw[x:y] for x, y in zip(starts, ends)]
                continue
        out += [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(some, add_special_tokens=False)]
    return out


def _encode_unseen(path: str, chunks: list[str], cache: dict[str, bytes]) -> None:
    """Put the ids of chunks into the cache, with those of their pieces."""
    import numpy as np

    tok, _, separator = _load(path)
    found = _model(path)
    words, cut, odd = [], {}, []
    for c in chunks:
        if found and _WORD.fullmatch(c):
            words.append(c)
        elif found and _PLAIN.fullmatch(c) and "<|" not in c:
            cut[c] = _PIECES.findall(c)
        else:
            odd.append(c)
    words = list(set().union(words, *cut.values()).difference(cache))
    if words:
        model, letters = found
        ids, ends = [], []
        text = " ".join(words).encode().decode("latin-1")       # a letter for each byte
        for a, b in letters:
            text = text.replace(a, b)
        for w in text.split(" "):
            ids += [t.id for t in model.tokenize(w)]
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        cache.update(zip(words, [raw[x:y] for x, y in zip([0, *ends], ends)]))
    cache.update([(c, b"".join([cache[p] for p in some])) for c, some in cut.items()])
    cache.update(zip(odd, _encode_chunks(tok, separator, odd)))


def _ids_of(path: str, chunks: list[str]) -> list[bytes]:
    cache = _load(path)[1]
    missing = [c for c in chunks if c not in cache]
    if missing:
        if len(cache) + len(missing) > CACHE_CHUNKS:
            cache.clear()
            cache[""] = b""
            missing = [c for c in chunks if c]
        _encode_unseen(path, missing, cache)
    return [cache[c] for c in chunks]


def runs_of(texts: list[str]):
    """Ranges of texts of at most ``RUN_CHARS`` characters, or one text."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > RUN_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    out: list[bytes] = []
    for lo, hi in runs_of(texts):
        plain = pa.array([lowered(t).replace("\n", " ") for t in texts[lo:hi]], pa.large_string())
        split = pc.split_pattern(pc.replace_substring_regex(plain, _TAIL, r"\1 \2\3"), " ")
        coded = split.flatten().dictionary_encode()
        found = coded.dictionary        # its strings hold no blank
        found = pc.binary_join(pa.LargeListArray.from_arrays([0, len(found)], found), pa.scalar(" ", found.type))[0].as_py().split(" ")
        ids = pa.array(_ids_of(path, found), pa.large_binary()).take(coded.indices)
        # a text's ids lie between the ends of its first and last chunk
        _, ends, data = ids.buffers()
        at = np.frombuffer(ends, np.int64, len(ids) + 1)[split.offsets.to_numpy()].tolist()
        raw = memoryview(data or b"")
        out += [raw[x:y].tobytes() for x, y in zip(at, at[1:])]
    return out
