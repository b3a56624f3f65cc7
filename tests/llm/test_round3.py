"""Filter audit, odd-sketch dedup and spelling variants against brute force."""

import os
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from costlens.llm import filter_audit, langid, odd_sketch, queries, rounds, spelling, template_decon, topk
from test_operators import BASE, ODD, SF, edited, key, pairs, prose, small_docs

LABELS = "doc_id long, quality int, toxic int"


# ---- 11 ----

def fails(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}


def audit(rows, labels):
    """rows (doc_id, text, source), labels (doc_id, quality, toxic) -> the report's rows."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    docs = [(p or "", fails(t) | {"E": i is not None and i > least[t or ""]}, i in good, i in toxic) for i, t, p in rows]
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        report = []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                report.append((part, "".join(order), k + 1, len(left), len(gone), sum(d[1][f] for d in own) - len(gone),
                               sum(d[1][f] and sum(d[1].values()) == 1 for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f))
        out += [r[:-1] + (shapley[r[-1]],) for r in report]
    return sorted(out)


def report(df):
    return sorted(map(tuple, df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                       "good_lost", "toxic_lost", "shapley").collect()))


def test_audit_matches_brute_force_and_sql(llm_spark, duck):
    got = report(queries.QUERIES["op11_filter_audit"](llm_spark, SF))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in small_docs(llm_spark).collect()]
    labels = [tuple(r) for r in llm_spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got == audit(rows, labels)
    twin = duck.execute(queries.SQL["op11_filter_audit"])
    names = [d[0] for d in twin.description]
    assert names == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(twin.fetchall()) == got


def test_audit_on_odd_rows(llm_spark):
    r = random.Random(5)
    texts = [None, "", " \n", "A B C", "a # b", "x " * 250, prose(1, 300), prose(1, 300) + " |", "É" * 10 + "AB", "word\x1cword"]
    rows = [(i, r.choice(texts), r.choice(["s", "s", "t", None, ""])) for i in range(120)]
    rows += [(None, "A B C", "s"), (None, "A B C", "s"), (3, "A B C", "t"), (3, "A B C", "t"), (0, prose(2, 30000), "u")]
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, 1), (9999, 1, 1)]
    df = llm_spark.createDataFrame([(i, t, p, "x", 1) for i, t, p in rows], "doc_id long, text string, source string, part string, n long")
    marks = llm_spark.createDataFrame([x + ("z",) for x in labels], LABELS + ", text string")
    assert report(filter_audit.audit(df, marks)) == audit(rows, labels)


def test_audit_of_nothing(llm_spark, docs_of):
    assert filter_audit.audit(docs_of([]), llm_spark.createDataFrame([], LABELS)).count() == 0


def test_contraction_is_a_sum_over_cells():
    t = np.random.default_rng(1).integers(0, 99, (2,) * 5)
    v = np.array([[[1, 0], [0, 1], [1, 1], [1, 1], [1, 0]]])
    assert filter_audit.contract(t, v)[0] == t[0, 1, :, :, 0].sum()


# ---- 12 ----

def test_near_duplicates_match_brute_force(llm_spark, docs_of):
    for rows in (pairs(small_docs(llm_spark)), [r for r in ODD if r[0] is not None]):
        for n, percent in ((5, 85), (5, 80)):
            got = odd_sketch.near_duplicates(docs_of(rows), n, percent).collect()
            want = brute.jaccard(rows, n, percent)
            assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
            assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_a_large_group(docs_of, monkeypatch):
    """Chains and near misses in one group, with few pivots and small groups."""
    monkeypatch.setattr(rounds, "PIVOTS", 3)
    monkeypatch.setattr(rounds, "ROWS_PER_GROUP", 8)
    base = prose(11, 150)
    rows = [(i, edited(base, i, 1 + i % 8)) for i in range(150)] + [(1000 + i, base) for i in range(20)]
    got = odd_sketch.near_duplicates(docs_of(rows), 5, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute.jaccard(rows, 5, 85)


def test_near_duplicates_of_odd_rows(docs_of):
    assert odd_sketch.near_duplicates(docs_of([])).count() == 0
    got = odd_sketch.near_duplicates(docs_of([(None, BASE), (None, "alone " * 9), (4, BASE), (4, BASE), (7, None), (7, "")])).collect()
    rows = sorted(((r["doc_id"], r["n_shingles"] > 0, r["component_id"], r["kept"]) for r in got), key=key)
    assert rows == sorted([(None, True, 4, False), (None, True, None, True), (4, True, 4, True), (4, True, 4, True),
                           (7, False, 7, True), (7, False, 7, True)], key=key)


def test_linked_sets_pass_their_sketches():
    r = np.random.default_rng(2)
    for n in (8, 30, 200, 3000, 20000):
        for _ in range(20):
            only = int(0.15 * n / 1.85)
            common = r.integers(0, 2**63, n, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, r.integers(0, 2**63, only, dtype=np.uint64)])) for _ in range(2))
            same = len(np.intersect1d(a, b))
            assert 100 * same >= 85 * (len(a) + len(b) - same)
            grid = odd_sketch.samples(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            x, y = odd_sketch.odd_sketches(grid)
            assert np.bitwise_count(x ^ y).sum() <= odd_sketch.most_odd(85)
            x, y = (np.frombuffer(rounds.set_sketch(v), np.uint8) for v in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= rounds.most_of_sets(np.array(len(a) + len(b)), 85)
            assert (odd_sketch.band_keys(grid)[0] == odd_sketch.band_keys(grid)[1]).any()


# ---- 13 ----

def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    by = {}
    for w in n:
        for v in {w[:i] + w[i + 1:] for i in range(len(w))} | {w}:
            by.setdefault(v, set()).add(w)
    form, count = {}, {}
    for w in n:
        some = {x for v in {w[:i] + w[i + 1:] for i in range(len(w))} | {w} for x in by[v] if near(w, x)}
        count[w] = len(some)
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out, key=key)


def found(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=key)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_variants_match_brute_force(llm_spark, folder):
    df = llm_spark.read.parquet(f"{folder}/documents.parquet")
    got = found(queries.QUERIES["op13_spelling_variants"](llm_spark, folder))
    assert got == variants(pairs(df)) and len(got) > 100


def test_variants_in_chains_ties_and_odd_words(docs_of, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    words = {"mainword": 700, "mainwort": 130, "mainwork": 30, "maimwork": 5, "mainwor": 130, "nainword": 5,      # chains and ties
             "aaaaaa": 30, "aaaaaaa": 6, "aaaaab": 6, "baaaaa": 5, "ééééàà": 40, "éééééà": 8, "straße": 50, "strase": 9,
             "x×÷ÿàé": 30, "x×÷ÿàè": 6, "q" * 3000: 5, "q" * 3001: 32, "short": 99, "rare" * 2: 4}
    text = [w for w, c in words.items() for _ in range(c)]
    random.Random(1).shuffle(text)
    rows = [(k, ("-" if k % 2 else "中 ").join(text[i:i + 50])) for k, i in enumerate(range(0, len(text), 50))]
    rows += [(None, "MAINWORD Mainword ÉÉÉÉÀÀ"), (None, None), (3, ""), (3, "mainword " * 3), (3, "mainword " * 3)]
    got = found(spelling.variants(docs_of(rows)))
    assert got == variants(rows)
    roots = {r[0]: r[2] for r in got}
    assert roots["maimwork"] == "mainword" and roots["q" * 3000] == "q" * 3001


def test_variants_of_nothing(docs_of):
    assert spelling.variants(docs_of([])).count() == 0
    assert spelling.variants(docs_of([(1, "few words only"), (2, None)])).count() == 0


def test_neighbourhoods_are_full():
    """Every edit of a letter gives a neighbour of the reduced word."""
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzàéñöÿ"
    for size in (6, 7, 12):
        w = "".join(r.choice(letters) for _ in range(size))
        keys = {int(k) for _, ks in spelling.neighbourhoods([w]) for k in ks}
        for v in [w] + [w[:i] + c + w[i + k:] for i in range(size + 1) for c in ["", *letters] for k in (0, 1)
                        if (c or k) and i + k <= size]:
            assert int(spelling.reduced([v])[0]) in keys
        assert len(keys) <= 1 + size + size * (spelling.SYMBOLS - 1) + (size + 1) * spelling.SYMBOLS


# ---- edges of earlier operators ----

VECTORS = "vec_id long, embedding array<double>"


def test_top_k_of_empty_vectors(llm_spark):
    rows = [(i, [] if i % 3 else [float(i), -1.5]) for i in range(0, 41)] + [(100, []), (120, [])]
    want = brute_top(rows)
    for parts in (1, 7):
        got = topk.search_every(llm_spark.createDataFrame(rows, VECTORS).repartition(parts)).collect()
        assert sorted(map(tuple, got)) == want
    only = topk.search_every(llm_spark.createDataFrame([(20, []), (40, [])], VECTORS)).collect()
    assert sorted(map(tuple, only)) == [(20, 1, 40, 0), (40, 1, 20, 0)]


def brute_top(rows, every=20, k=20):
    wide = max(len(v) for _, v in rows)
    ok = [(i, [int(np.floor(64 * x)) for x in v] + [0] * (wide - len(v))) for i, v in rows]
    return sorted((q, r + 1, j, -s) for q, x in ok if q % every == 0 for r, (s, j) in enumerate(
        sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in ok if j != q)[:k]))


def test_top_k_is_exact_or_an_error(llm_spark):
    large = [(0, [3.0e7, 1.0, 1.0]), (1, [3.0e7, 5.0, 0.0]), (2, [-3.0e7, 2.0, 7.0]), (20, [1.0, 1.0, 2.0e7])]
    got = topk.search_every(llm_spark.createDataFrame(large, VECTORS)).collect()
    assert sorted(map(tuple, got)) == brute_top(large)          # beyond 2 ** 53, within 64 bits
    for bad in ([(0, [6.0e8, 0.0]), (1, [6.0e8, 1.0])], [(0, [1e300]), (1, [1.0])]):
        with pytest.raises(Exception, match="64-bit"):
            topk.search_every(llm_spark.createDataFrame(bad, VECTORS)).collect()


def test_clean_documents_judges_rows(llm_spark, docs_of):
    item = "In which year did the famous painter Marlowe finish 12 of the large blue murals in Vienna"
    bench = llm_spark.createDataFrame([(1, item)], "item_id long, text string")
    bad, good = prose(21, 30) + " " + item + " " + prose(22, 30), prose(23, 60)
    rows = [(None, bad), (None, good), (5, bad), (5, good), (6, good), (7, None), (8, "")]
    kept = pairs(template_decon.clean_documents(docs_of(rows), bench))
    assert sorted(kept, key=key) == sorted([(None, good), (5, good), (6, good), (7, None), (8, "")], key=key)


def test_language_stage_without_labels(llm_spark, docs_of):
    rows = [(1, "some words"), (2, None), (3, "12 34"), (4, "été")]
    df = docs_of(rows).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(pairs(langid.identified_documents(df))) == [(1, "some words"), (4, "été")]


def test_pipeline_runs_whole(llm_spark, tmp_path):
    """run() over written tables: each stage against what its operator must do."""
    import corpus_pipeline
    item = "In which year did the famous painter Marlowe finish 12 of the large blue murals in Vienna"
    passage = prose(31, 60)
    texts = [prose(i, 80 + i) for i in range(40, 60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100, texts[3]), (101, edited(texts[4], 1, 1)), (102, "12 34 !"), (103, None), (104, texts[5] + " " + item),
             (105, prose(70, 90) + " " + passage), (106, prose(71, 90) + " " + passage), (7, prose(72, 50)), (None, prose(73, 50))]
    docs = llm_spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    llm_spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(llm_spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in out}
    assert kept == {*range(20), 105, 106, None}                     # copies, near copies, no language and contamination go
    # what is packed are the texts without the passage that two of them share
    base = [t for i, t in rows if i not in (100, 101, 102, 103, 104)]
    left = brute_cut(base)
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = sorted(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in left)
    by = {}
    for r in out:
        by.setdefault((r["doc_id"], r["doc_tokens"]), 0)
        by[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert sorted(r["doc_tokens"] for r in out if r["start"] == 0) == sizes
    llm_spark.createDataFrame([], docs.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    llm_spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(llm_spark, f"{tmp_path}/none").count() == 0


def brute_cut(texts, length=200):
    raw = [t.encode() for t in texts]
    seen = Counter(b[k:k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = set()
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone.update(range(k, k + length))
        out.append(bytes(x for i, x in enumerate(b) if i not in gone).decode(errors="ignore"))
    return out


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op5_exact_top_k", "op12_odd_sketch_dedup"])
def test_sql_twins(llm_spark, duck, name):
    df = queries.QUERIES[name](llm_spark, SF)
    twin = duck.execute(queries.SQL[name])
    names = [d[0] for d in twin.description]
    assert names == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(twin.fetchall())


def test_chunks_are_encoded_as_they_are_alone():
    """Joined chunks give the ids of single ones, also where a chunk holds the
    separator, marks, special strings or nothing that is a token."""
    from costlens.llm import tokens
    tok, _, separator = tokens._load(tokens.tokenizer_path())
    assert separator is not None
    word = separator[0]
    chunks = ["plain", "été", "a.b", "...", "x" * 300, "\u0301mark", "<|endoftext|>", "\t", "日本", "it's", "don't.", "ΣΑΣ"]
    for some in (chunks, [*chunks, word], [word, word], [f"{word}s", f"1{word}"], ["one"]):
        want = [np.array(tok.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in some]
        assert tokens._encode_chunks(tok, separator, some) == want
        assert tokens._encode_chunks(tok, None, some) == want


def test_ids_are_the_tokenizers_whatever_the_path():
    """Chunks cut here, chunks left to the tokenizer, special strings (which the
    tokenizer looks for before it lower-cases) and mixes of them."""
    from costlens.llm import tokens
    path = tokens.tokenizer_path()
    tok = tokens._load(path)[0]
    texts = ["a <|ENDOFTEXT|> B.", "A<|endoftext|>b,", "it's IT'S. we'll- 'll", "a_b-c@d.com 1234 x9,9!!", "Straße ÆØÅ ÷×, ÿ. é, \u0301",
             "\u00aa\u00ba \u00b5 x\u00b2 \u00bd", "\x85 \xa0x\ty\r\nz", "\u4e2d. \u03a3\u03b1\u03c2, \u0130I.", "x" * 1000 + ".", "\n", ""]
    draw = random.Random(5)
    for letters in ("abz\u00e9\u00df\u00ff\u00f7A\u00c9Z019.,!'<|>_- \n\t\u0301\u4e2d  ", "abcde\u00e9\u00f1.,!#'-1  "):
        texts += ["".join(draw.choice(letters) for _ in range(draw.randrange(50))) for _ in range(2000)]
    assert tokens._model(path) is not None
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):      # unseen, then from the cache
        assert [np.frombuffer(e, "<u4").tolist() for e in tokens.encode_texts(texts, path)] == want


def test_texts_are_split_in_bounded_runs(monkeypatch):
    from costlens.llm import tokens
    path = tokens.tokenizer_path()
    texts = ["one two", "", "three " * 50, "four", "five six"]
    whole = tokens.encode_texts(texts, path)
    monkeypatch.setattr(tokens, "RUN_CHARS", 12)
    assert list(tokens.runs_of(texts)) == [(0, 2), (2, 3), (3, 5)]
    assert tokens.encode_texts(texts, path) == whole
    assert list(tokens.runs_of([])) == [] and tokens.encode_texts([], path) == []


def test_plain_chunks_skip_the_slow_path(monkeypatch):
    """Only chunks that the tokenizer must normalise or cut reach it as a whole,
    and a mark at a word's end makes no new chunk."""
    from costlens.llm import tokens
    sent, path = [], tokens.tokenizer_path()
    monkeypatch.setattr(tokens, "_LOADED", {})
    real = tokens._encode_chunks
    monkeypatch.setattr(tokens, "_encode_chunks", lambda tok, sep, chunks: sent.extend(chunks) or real(tok, sep, chunks))
    tokens.encode_texts(["Plain words, of plaineau \u00e9t\u00e9. don't plain###", "words. mail3@x.org Words", "a\tb"], path)
    assert sorted(sent) == ["a\tb", "don't"]
    assert not {"words,", "words.", "plain###"} & set(tokens._LOADED[path][1])


def test_training_order_shuffles_a_share_at_a_time(llm_spark, docs_of, tmp_path, monkeypatch):
    """The shards are written by jobs of a share of the sequences each, and a job's
    shuffle files are gone when it ends."""
    from costlens.llm import train_order
    rows = [(i, f"word{i} " * (20 * (i % 9))) for i in range(200)]
    env = llm_spark._jvm.org.apache.spark.SparkEnv

    def shuffled():
        files = env.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return sum(os.path.getsize(f) for f in files if f.endswith(".data") and "/shuffle_" in f and os.path.exists(f))

    written, left, real = [], [], train_order.materialize

    def counted(df, name="stage", **options):
        before = shuffled()
        out = real(df, name, **options)
        if name == "training-order":
            left.append(shuffled() - before)
            written.append(out.count())
        return out

    monkeypatch.setattr(train_order, "materialize", counted)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = llm_spark.conf.get(key, None)
    m = train_order.write_training_order(docs_of(rows), f"file://{tmp_path}/shares", stride=16, shard_bytes=3_200)
    assert llm_spark.conf.get(key, None) == before
    n = m.count()
    assert sum(written) == n and n > 1000 and len(written) == train_order.PASSES
    assert max(written) <= n / train_order.PASSES + 100     # a shard's records
    assert all(x <= 0 for x in left)
    got = train_order.read_slots(m, f"file://{tmp_path}/shares", stride=16).collect()
    assert sorted(r["slot"] for r in got) == list(range(n))
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
