"""Operators against brute force, on the driver's small tables and on edge rows."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from costlens.llm import (chat_format, components, crf, hilbert, langid, ngram_join, packing, queries, rindex, rounds,
                          template_decon, topk, tokens, train_order)

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in "ka lo mi ne ru so ta vi".split() for b in "bar den fil gom hus jat kel".split()]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, seed, k):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"x{r.randrange(999)}"
    return " ".join(w)


BASE = prose(1, 300)
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "One TWO"), (6, "one two"), (7, BASE), (8, BASE), (8, BASE),
       (9, BASE + " " + prose(2, 20)), (10, prose(3, 20000)), (None, "null id here and there"), (12, "é è ñ ü " * 40)]
ODD += [(100 + i, edited(BASE, i, 1 + i % 9)) for i in range(40)]


def small_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(x):
    return tuple((v is None, v) for v in x)


# ---- 1 ----

def test_ngram_join_matches_brute_force(llm_spark, docs_of):
    for rows in (pairs(small_docs(llm_spark)), [r for r in ODD if r[0] is not None]):
        got = ngram_join.jaccard_components(docs_of(rows)).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == brute.jaccard(rows)


def test_ngram_join_other_threshold_and_pivots(docs_of, monkeypatch):
    monkeypatch.setattr(rounds, "PIVOTS", 2)                      # many rounds
    monkeypatch.setattr(rounds, "ROWS_PER_GROUP", 4)
    rows = [r for r in ODD if r[0] is not None]
    got = ngram_join.jaccard_components(docs_of(rows), 5, 80).collect()
    assert sorted(map(tuple, got)) == brute.jaccard(rows, 5, 80)


def test_ngram_join_empty_and_null_id(docs_of):
    assert ngram_join.jaccard_components(docs_of([])).count() == 0
    got = ngram_join.jaccard_components(docs_of([(None, "a b c d e"), (3, "a b c d e")])).collect()
    assert {r["component_id"] for r in got} == {3}


def test_first_of_each_keeps_one(docs_of):
    rows = [(5, BASE), (4, BASE), (4, BASE), (7, "other words entirely here now"), (8, None)]
    kept = ngram_join.first_of_each(docs_of(rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [4, 7, 8]


def test_first_of_each_decides_by_row(docs_of):
    a, b, c = BASE, prose(4, 40), prose(5, 40)
    rows = [(None, a), (None, b), (None, b), (7, c), (7, "unlike words under one id here"),      # unlike texts, one id or none
            (3, a), (5, a), (5, prose(6, 40)), (8, None), (8, ""), (8, None), (None, " ")]       # and the copy (5, a) goes
    kept = sorted(pairs(ngram_join.first_of_each(docs_of(rows))), key=key)
    assert kept == sorted([(None, b), (7, c), (7, "unlike words under one id here"), (3, a), (5, prose(6, 40)),
                           (8, None), (8, ""), (8, None), (None, " ")], key=key)


def test_signatures_bound_the_difference():
    r = np.random.default_rng(6)
    for n, m, both in ((1, 1, 0), (1, 1, 1), (40, 37, 30), (500, 700, 450), (3000, 20, 20), (9000, 8800, 0)):
        pool = r.integers(0, 1 << 63, n + m, dtype=np.uint64)
        a, b = pool[:n], np.concatenate((pool[:both], pool[n:n + m - both]))
        least = int(np.bitwise_count(np.frombuffer(rounds.set_sketch(a), "<u8") ^ np.frombuffer(rounds.set_sketch(b), "<u8")).sum())
        assert least <= n + m - 2 * both and (least > 0) == (n + m > 2 * both)


def test_components_of_a_long_chain(llm_spark):
    links = llm_spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, components.components(links).collect()))
    assert got[60] == 0 and got[101] == 100


# ---- 2 ----

TURNS = "conv_id long, turn long, role string, text string, extra int"


def test_chat_round_trip(llm_spark):
    bad = ["\\", "\\\\### ", "### Assistant: </turn> ok", " </turn>\n", "a </turn>", "\n </turn", None, "", "é### User: "]
    rows = [(1, i, r, t, 0) for i, (r, t) in enumerate((r, t) for t in bad for r in ("user", "assistant"))]
    rows += [(2, 0, "assistant", "too soon", 0), (2, 0, "assistant", "too soon", 0), (None, None, None, None, 0),
             (3, 1, "=odd: role\\", "x", 0), (3, 0, "User", "y", 0)]
    got = chat_format.read_back(chat_format.format_chat(llm_spark.createDataFrame(rows, TURNS))).collect()
    want = brute.chats([(c, t, r, x) for c, t, r, x, _ in rows])
    assert {r[0]: (r[1], r[2], r[3], r[4]) for r in got} == want
    flags = {r["conv_id"]: r["valid"] for r in got}
    assert flags[1] is True and flags[2] is False and flags[3] is False
    empty = chat_format.read_back(chat_format.format_chat(llm_spark.createDataFrame([], TURNS)))
    assert empty.count() == 0


def test_chat_parses_whole_conversations():
    t = chat_format.Template()
    turns = [("user", "a </turn>\n### User: b"), ("tool", "\\"), ("assistant", "### ")]
    text = "".join(s for r, x in turns for s, _ in t.segments(r, x))
    assert t.parse(text) == turns


def test_chat_query(llm_spark):
    got = {r[0]: tuple(r)[1:5] for r in queries.op2_chat_format(llm_spark, SF).collect()}
    rows = [tuple(r) for r in llm_spark.read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    want = brute.chats(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert got == want


# ---- 3 ----

def test_curve_visits_neighbours(llm_spark):
    for dims, bits in ((2, 3), (3, 2), (4, 1)):
        cells = llm_spark.range(1 << (dims * bits))
        axes = [F.expr(f"cast((id >> {bits * i}) & {(1 << bits) - 1} as int)") for i in range(dims)]
        got = cells.select(hilbert.curve_index(axes, bits).alias("h"), *[a.alias(f"x{i}") for i, a in enumerate(axes)])
        path = [tuple(r)[1:] for r in sorted(got.collect())]
        assert len(path) == len(set(path)) == 1 << (dims * bits)
        assert all(sum(abs(p - q) for p, q in zip(a, b)) == 1 for a, b in zip(path, path[1:]))


def test_shards_are_even_and_gapless(llm_spark, docs_of):
    for df in (small_docs(llm_spark), docs_of(ODD), docs_of([])):
        rows = hilbert.shard_documents(df, 8).collect()
        assert len(rows) == df.count()
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(i, [])) for i in range(8)]
        assert max(sizes) - min(sizes) <= 1
    text = dict(pairs(docs_of([r for r in ODD if r[0] != 8])))
    for r in hilbert.shard_documents(docs_of([x for x in ODD if x[0] != 8]), 8).collect():
        raw = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)


def test_shards_prune_files(llm_spark, tmp_path):
    hilbert.write_shards(hilbert.shard_documents(small_docs(llm_spark), 8), str(tmp_path / "s"))
    back = llm_spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and {"shard", "slot", "size"} <= set(back.columns)


# ---- 4 ----

@pytest.mark.parametrize("domain", [1, 2, 7, 1000, 4097])
def test_feistel_is_a_permutation(domain):
    p = train_order.feistel(np.arange(domain), domain, 5)
    assert sorted(p.tolist()) == list(range(domain))
    assert train_order.feistel(p, domain, 5, back=True).tolist() == list(range(domain))


def test_training_order_reads_back(llm_spark, docs_of, tmp_path):
    for n, df in enumerate((docs_of(ODD), docs_of([]))):
        out = f"file://{tmp_path}/order{n}"
        m = train_order.write_training_order(df, out, stride=64, shard_bytes=20_000)
        rows = train_order.read_slots(m, out, stride=64).collect()
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
        whole = {}
        for r in sorted(rows, key=lambda r: r["seq"]):
            if r["doc_id"] in (4, 9, 10):
                whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + bytes(r["ids"])
        for d, ids in whole.items():
            e = np.frombuffer(tokens.encode_texts([dict(ODD)[d]], tokens.tokenizer_path())[0], "<u4").astype("<u2")
            assert ids == e.tobytes() + np.array([train_order.END_ID], "<u2").tobytes()


def test_training_order_is_the_permutation(docs_of, tmp_path, monkeypatch):
    """Slots are the permutation of dense numbers, content is that of every row
    (null ids and repeated rows included), reading resumes in mid-shard, and ids
    may take four bytes."""
    rows = [*ODD, (3 * 10 ** 18, "far"), (-3 * 10 ** 18, "away")]
    for width in (2, 4):
        monkeypatch.setattr(train_order, "id_width", lambda *a, w=width: w)
        out = f"file://{tmp_path}/wide{width}"
        m = train_order.write_training_order(docs_of(rows).repartition(5), out, stride=64, shard_bytes=5_000 * width)
        got = train_order.read_slots(m, out, stride=64, width=width).collect()
        n = len(got)
        assert sorted(r["number"] for r in got) == list(range(n)) and n > 200
        slots = train_order.feistel(np.array([r["number"] for r in got]), n, 17)
        assert slots.tolist() == [r["slot"] for r in got]
        per = 5_000 // 64
        assert all(divmod(r["slot"], per) == (r["shard"], r["record"]) for r in got)
        kind = f"<u{width}"
        whole = {}
        for r in sorted(got, key=lambda r: r["number"]):
            if r["seq"] == 0:
                last = whole.setdefault(r["doc_id"], [])
                last.append(b"")
            whole[r["doc_id"]][-1] += bytes(r["ids"])
        want = {}
        for i, t in rows:
            e = np.frombuffer(tokens.encode_texts([t or ""], tokens.tokenizer_path())[0], "<u4").astype(kind)
            want.setdefault(i, []).append(e.tobytes() + np.array([train_order.END_ID], kind).tobytes())
        assert {i: sorted(v) for i, v in whole.items()} == {i: sorted(v) for i, v in want.items()}
        by_slot = {r["slot"]: bytes(r["ids"]) for r in got}
        for start in (0, 1, per - 1, per, n // 2, n - 1):
            read = list(train_order.resume(out, start, 5_000 * width, 64, width))
            assert len(read) == n - start
            for k, x in enumerate(read):
                ids = np.frombuffer(by_slot[start + k], kind)
                assert (x[:len(ids)] == ids).all() and (x[len(ids):] == 256 ** width - 1).all()


# ---- 5 ----

def test_top_k_matches_brute_force(llm_spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 8) / 64]) for i in range(300)]
    rows += [(400, None), (None, [0.5] * 8), (420, [float("nan")] * 8), (440, [None] + [0.1] * 7),
             (460, [float("inf")] * 8), (480, [1e12, -1e12] + [0.0] * 6), (500, [])]
    df = llm_spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.search_every(df).collect()))
    pad = [(i, None if v is None else v + [0.0] * (8 - len(v))) for i, v in rows]
    assert got == brute.top_k(pad)
    assert topk.search_every(df.limit(0)).count() == 0


# ---- 6 ----

def test_repeats_match_brute_force(llm_spark, docs_of):
    passage = prose(50, 60)
    rows = [r for r in ODD if r[0] not in (None, 10)]
    rows += [(200 + i, prose(60 + i, 30) + " " + passage + " " + prose(80 + i, 10)) for i in range(15)]
    rows += [(300, "a" * 1000), (301, "ab" * 400), (302, passage[:199]), (303, prose(99, 5) + "a" * 205), (304, "é" * 99)]
    for case in (pairs(small_docs(llm_spark)), rows):
        got = rindex.removal_digest(docs_of(case)).drop("removed").collect()
        assert sorted(map(tuple, got)) == brute.repeats(case)
    assert rindex.removal_digest(docs_of([])).count() == 0


def test_very_common_anchors_are_counted(docs_of, monkeypatch):
    monkeypatch.setattr(rindex, "MOST", 2)
    passage = prose(51, 60)
    rows = [(i, prose(100 + i, 20) + " " + passage + " " + prose(200 + i, 20)) for i in range(12)]
    got = rindex.removal_digest(docs_of(rows)).drop("removed").collect()
    assert sorted(map(tuple, got)) == brute.repeats(rows)


def test_statistics_of_an_index_block():
    r = random.Random(4)
    parts = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 60))) for _ in range(12)] + [b"abab", b"abab"]
    stat, begin, n_runs = rindex.matching_statistics(parts)
    places = [(k, i) for k, p in enumerate(parts) for i in range(len(p))]
    for k, i in places:
        best = 0
        for q, j in places:
            if (q, j) != (k, i):
                a, b = parts[k][i:], parts[q][j:]
                best = max(best, next((x for x, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b))))
        assert stat[begin[k] + i] == best
    assert 0 < n_runs <= len(places)


def test_cut_texts_stay_valid(docs_of):
    rows = [(1, "é" * 300), (2, "x" + "é" * 300), (3, "clean words"), (4, None)]
    kept = {r["doc_id"]: r["text"] for r in rindex.without_repeats(docs_of(rows)).collect()}
    assert kept == {2: "x", 3: "clean words", 4: None}


# ---- 7 and 8 ----

def test_toxicity_on_held_out_rows(llm_spark, docs_of):
    texts = [(i, prose(i, 40) + (" vilebad" if i % 4 == 0 else "") + " " + prose(900 + i, 5)) for i in range(400)]
    labels = llm_spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    rows = crf.toxicity_of_documents(docs_of(texts + [(1000, None), (1001, "")]), labels).collect()
    assert len(rows) == 402 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    t = dict(texts)
    for r in rows:
        if r["doc_id"] in t and r["doc_id"] % 4 == 0:
            assert any("vilebad" in t[r["doc_id"]].encode()[s["start"]:s["end"]].decode() for s in r["spans"])
    assert crf.toxicity_of_documents(docs_of([]), labels).count() == 0
    assert crf.toxicity_of_documents(docs_of([(1, "x")]), labels.limit(0)).count() == 1


def test_lexicon_keeps_every_leaning_word(llm_spark, monkeypatch):
    monkeypatch.setattr(crf, "LEXICON", 5, raising=False)       # the former cut by rank
    rows = [(1, f"strong {WORDS[i // 3]}") for i in range(90)] + [(0, "strong")] * 35 + [(0, "plain")] * 800
    words = crf.lexicon(llm_spark.createDataFrame(rows, "toxic int, text string"))
    assert {(90, 35), (3, 0)} <= set(zip(words.bad.tolist(), words.good.tolist())) and len(words.h) >= 31
    assert (np.diff(words.h.astype(object)) > 0).all()


def test_strength_of_a_word_does_not_grow_with_the_rows(llm_spark, docs_of):
    def bin_at(n, p, q):
        k = np.array([n // 10])
        return crf.bins_of(crf.strength((k * p).astype(int), ((n - k) * q).astype(int), int(k[0]), int(n - k[0])))[0]
    mark = crf.bins_of(np.array([crf.MARK]))[0]
    assert [bin_at(n, 0.205, 0.2) for n in (8_000, 2_400_000, 12_000_000)] in ([0, 1, 1], [0, 0, 0], [0, 0, 1])
    slur = [bin_at(n, 0.2, 0.002) for n in (8_000, 2_400_000, 12_000_000)]
    assert min(slur) >= mark > 1 and max(slur) - min(slur) <= 1
    # sixteen copies of one toxic text are one row
    texts = [(i, "copied wordsof prose" if i < 16 else prose(i, 30) + (" vilebad" if i % 5 == 0 else "")) for i in range(200)]
    labels = llm_spark.createDataFrame([(i, int(i < 16 or i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    words = crf.train(docs_of(texts), labels).words
    assert words.n_bad == sum(i % 5 == 0 for i in range(16, 200)) + 1 and words.bad.max() == words.n_bad - 1
    assert not (words.bad == 16).any() and not (words.bad < crf.LEAST_DOCS).any()


def test_marginals_match_enumeration():
    r = np.random.default_rng(1)
    score, move, begin = r.normal(size=(4, 2)), r.normal(size=(2, 2)), r.normal(size=2)
    p, _, _ = crf.forward_backward(score, np.array([0, 4]), move, begin)
    total, on = 0.0, np.zeros(4)
    for path in np.ndindex(2, 2, 2, 2):
        w = np.exp(begin[path[0]] + sum(score[t, s] for t, s in enumerate(path))
                   + sum(move[a, b] for a, b in zip(path, path[1:])))
        total += w
        on += w * np.array(path)
    assert np.allclose(p, on / total)


def test_languages_and_spans(llm_spark, docs_of):
    docs = small_docs(llm_spark)
    rows = langid.language_of_documents(docs, with_spans=True).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    model = langid.train(docs.select("text", "lang"))
    t = dict(pairs(docs))
    lang = {r["doc_id"]: r["lang"] for r in rows}
    one = {x: max((t[d] for d in t if lang[d] == x), key=len) for x in ("en", "de")}
    mixed = one["en"][:1500] + "\n" + one["de"][:1500]
    got = langid.identify(docs_of([(1, mixed), (2, None), (3, "12 %"), (4, "Привет")]), model).orderBy("doc_id").collect()
    assert {s["lang"] for s in got[0]["spans"]} >= {"en", "de"} and [r["lang_pred"] for r in got[1:3]] == ["und", "und"]
    assert langid.language_of_documents(docs_of([])).count() == 0
    kept = langid.keep_identified(docs_of([(1, mixed), (2, None), (3, "12 %")]), model)
    assert [r["doc_id"] for r in kept.collect()] == [1] and kept.columns == docs.columns


def test_viterbi_matches_enumeration():
    r = np.random.default_rng(2)
    s = r.normal(size=(7, 3)).astype(np.float32) * 3
    first = np.array([0, 0, 4, 7])
    got = langid.viterbi(s, first, 2.0)
    for a, z in zip(first, first[1:]):
        if z > a:
            best = max(np.ndindex(*[3] * (z - a)), key=lambda p: sum(s[a + t, x] for t, x in enumerate(p))
                       - 2.0 * sum(x != y for x, y in zip(p, p[1:])))
            assert got[a:z].tolist() == list(best)


# ---- 9 ----

def test_templates(llm_spark, docs_of):
    item = "A train from Paris travels 120 km in 2 hours, so how many km does it cover in 5 hours at that speed"
    bench = llm_spark.createDataFrame([(1, item), (2, None), (3, "too few"), (4, prose(7, 20))], "item_id long, text string")
    same = item.replace("120", "90").replace("Paris", "Rome").replace("5 hours", "7 hours")
    rows = [(1, prose(8, 30) + ". " + item + " " + prose(9, 30)), (2, same), (3, prose(7, 20).upper()),
            (4, item.replace("120", "2").replace("Paris", "Rome")),    # 2 stands for two values
            (5, prose(10, 300)), (6, None), (7, ""), (8, item[:40])]
    got = {(r["doc_id"], r["item_id"]) for r in template_decon.contaminated(docs_of(rows), bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 4)}
    clean = template_decon.clean_documents(docs_of(rows), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [4, 5, 6, 7, 8]
    assert template_decon.contaminated(docs_of([]), bench).count() == 0


def test_templates_are_judged_by_occurrence(llm_spark, docs_of):
    item = "A train from Paris travels 120 km in 2 hours, so how many km does it cover in 5 hours at that speed"
    twice = ("first we pour 3 cups of the flour into a bowl then we rest a while and "
             "last we pour 8 cups of the flour into a bowl and bake it")
    bench = llm_spark.createDataFrame([(1, item), (2, twice)], "item_id long, text string")
    one, two = item.replace("120", "90").replace("Paris", "Rome"), item.replace("120", "95").replace("Paris", "New York")
    bad = item.replace("120", "2").replace("Paris", "Rome")
    rows = [(1, one + ". " + prose(11, 200) + ". " + two + "."),                     # two variants
            (2, one + ". " + prose(12, 50) + " how it travels 40 km in 3 hours, so how many more"),  # and a stray window
            (3, twice.replace("3 cups", "4 cups").replace("8 cups", "9 cups")),      # equal windows in one item
            (4, bad + ". " + prose(13, 50) + ". " + bad.replace("Rome", "Oslo")),    # 2 stands for two values in both
            (5, prose(14, 100)), (6, one), (6, two), (None, one), (None, bad)]
    got = {(r["doc_id"], r["item_id"]) for r in template_decon.contaminated(docs_of(rows), bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (6, 1), (None, 1)}


def test_short_and_dense_items_are_found(llm_spark, docs_of):
    items = ["Who wrote Don Quixote", "Compute 12 + 7 * 5 - 3", "Which of these was found first", "who holds it now",
             "7 1 8 2 8 1 8 2 8 4", "Why so"]
    bench = llm_spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, prose(20 + i, 20) + " " + t + " " + prose(30 + i, 20)) for i, t in enumerate(items)]
    rows += [(10, "We ask: who wrote Jane Eyre, and why it is so"), (11, "compute 12 + 7 * 5 - 4 and 3"),
             (12, prose(40, 9) + " Which of these was found, first"), (13, prose(41, 9) + " 7 1 8 2 8 1 8 2 8 5"),
             (14, "so they ask Paris of these was found first"), (15, items[0]), (16, None)]
    got = {(r["doc_id"], r["item_id"]) for r in template_decon.contaminated(docs_of(rows), bench).collect()}
    assert got == {(i, i) for i in range(len(items))} | {(12, 2), (15, 0)}


def test_planted_passages_are_found(llm_spark):
    rows = pairs(small_docs(llm_spark))
    items = [tuple(r) for r in llm_spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(d, i) for i, t in items for d, x in rows if x and t in x}
    got = {(r[0], r[1]) for r in queries.op9_template_decontamination(llm_spark, SF).collect()}
    assert want <= got


# ---- 10 ----

def test_packing(llm_spark, docs_of):
    path = tokens.tokenizer_path()
    rows = [r for r in ODD if r[0] not in (None, 8)]
    got = packing.pack(docs_of(rows)).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for d, t in rows:
        ids = tokens.encode_texts([t or ""], path)[0] + np.array([2], "<u4").tobytes()
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at:4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert sum(r["length"] for r in pieces) <= packing.CAPACITY
    assert packing.pack(docs_of([])).count() == 0
    one = packing.sequences(docs_of([(4, "one"), (5, "two")])).collect()
    assert len(one) == 1 and len(one[0]["ids"]) == 16


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer
    path = tokens.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = ["Don't stop. a., b!. c. 12.5, É. ÉÀ,", "", " ", "x\t.\r\ny z\x1cq", "中文。字. İI ΣΑΣ.", "<|endoftext|> a.́"]
    for t, e in zip(texts, tokens.encode_texts(texts, path)):
        assert np.frombuffer(e, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_plan_covers_every_piece():
    r = np.random.default_rng(3)
    demand = np.bincount(r.integers(0, 255, 500), minlength=256)
    p = packing.plan(demand, 256)
    assert all((u[-1] if len(u) else 0) == n for u, n in zip(p.upto, demand))
    assert p.sequences * 256 <= 1.05 * (demand * (np.arange(256) + 1)).sum() + 512


# ---- pipeline ----

def test_pipeline_stages(llm_spark, tmp_path):
    import corpus_pipeline as cp
    docs = small_docs(llm_spark)
    start = pairs(docs)
    for k, (name, stage) in enumerate(cp.STAGES):
        before = pairs(docs) if k < 5 else None
        out = stage(llm_spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs2 = llm_spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs2.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after = pairs(docs2)
        if name == "ngram_jaccard":
            least = {c for _, _, c in brute.jaccard(before, 5, 80)}
            assert sorted(d for d, _ in after) == sorted(least)
        if name == "run_length_dedup":
            kept = {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in after}
            want = {d: (sha, n - gone) for d, n, gone, _, sha in brute.repeats(before)}
            assert all(want[d][0] == h for d, h in kept.items() if want[d][1] == len(dict(after)[d].encode()))
            assert all(want[d][1] == 0 or not dict(before)[d].strip() for d in want if d not in kept)
        if name == "packing":
            assert {r["doc_id"] for r in docs2.collect()} == {d for d, _ in before}
        docs = docs2
    assert len(start) == 200
