"""Benchmark decontamination by template windows (DataFrame functions only).

Texts become words in which numbers, capitalised names inside a sentence and
the unit after a number are typed placeholders, so a question asked with other
values has the same template. Windows of ``WINDOW`` template words of the
benchmark and of every document meet in a hash join. A document is contaminated
by an item if it holds an occurrence of it: at least ``SHARE`` of the item's
distinct windows with consistent slots, so that every value on one side stands
for one value on the other. An occurrence is all matches of the text together
or, where those contradict each other, the matches of one position difference
(alone, or with the nearest match of each item window within half an item), so
that variants with other values and stray windows in a text are told apart.

An item of fewer than ``WINDOW`` words is one window of all its words, which
meets the documents' windows of as many words; null and empty texts match nothing.
A window needs ``LEAST`` plain words. Items in which a single window decides,
and those without any, are also found by their raw words, value for value and
all in a row. Whether an item's first word is a name depends on the text
before it, so its first window counts with that word as a name, too.

Repeated documents are reported for each row, repeated items for each id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.session import materialize

WINDOW = 5
LEAST = 3
SHARE = 0.8
#: Rows of benchmark windows up to which that side may be broadcast.
BROADCAST_ROWS = 200_000

# Units that are a slot when they follow a number.
UNITS = ("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr day days week weeks month months year "
         "years hour hours minute minutes second seconds meter meters metre metres mile miles gram grams "
         "kilogram kilograms pound pounds liter liters litre litres dollar dollars euro euros cent cents percent "
         "mph kmh degrees").split()

NUM, NAME, UNIT = "\u0001", "\u0002", "\u0003"


def marked_words(text: Column) -> Column:
    """Words in lower case; a slot's word starts with its type's mark."""
    t = F.translate(F.coalesce(text, F.lit("")), NUM + NAME + UNIT, "   ")
    # a capitalised word after a lower-case word or a comma is a name
    t = F.regexp_replace(t, r"(?<=[\p{Ll},] )(\p{Lu}\p{L}+)", NAME + "$1")
    t = F.regexp_replace(t, r"(?<![\p{L}\d])(\d+(?:[.,]\d+)*)", NUM + "$1 ")
    t = F.regexp_replace(t, rf"({NUM}\S+\s+)((?i:{'|'.join(UNITS)}))(?![\p{{L}}\d])", "$1" + UNIT + "$2")
    # other signs part words, but the marks and a number's inner dots stay
    t = F.regexp_replace(F.lower(t), rf"(?<!\d)[.,]|[.,](?!\d)|[^\p{{L}}\p{{M}}\d.,{NUM}{NAME}{UNIT}]+", " ")
    return F.filter(F.split(t, " +"), lambda w: w != "")


def windows(df: DataFrame, keys: list[str], sizes: list[int], raw: list[int]) -> DataFrame:
    """(keys, pos, h, slots, w): one row per window of ``sizes`` template words
    with enough plain words, and per window of ``raw`` words as they are; a
    shorter text is one window. ``slots`` holds the values of its slots in
    order, null without any; ``w`` the text's marked words."""
    words = df.select(*keys, marked_words(F.col("text")).alias("w"))
    tagged = words.select(
        *keys, "w", F.transform("w", lambda x: F.when(x < "\u0004", F.substring(x, 1, 1)).otherwise(x)).alias("t"),
        F.exists("w", lambda x: x < "\u0004").alias("any"))
    if raw:
        tagged = tagged.withColumn("r", F.transform("w", lambda x: F.translate(x, NUM + NAME + UNIT, "")))

    def every(k: int, one) -> Column:
        last = F.greatest(F.size("w") - k + 1, F.lit(1))
        return F.when(F.size("w") > 0, F.transform(F.sequence(F.lit(0), last - 1), one))

    def template(k: int) -> Column:
        def one(i: Column) -> Column:
            hashes = F.xxhash64(*[F.get(F.col("t"), i + j) for j in range(k)])
            mine = F.slice(F.col("w"), i + 1, k)
            slots = F.filter(mine, lambda x: x < "\u0004")
            plain = F.size(mine) - F.size(slots)
            return F.struct(
                i.alias("pos"), hashes.alias("h"),
                F.when(F.col("any") & (F.size(slots) > 0), slots).alias("slots"),
                F.when(F.col("any"), plain >= LEAST).otherwise(F.size("w") >= LEAST).alias("ok"))
        return every(k, one)

    def as_is(k: int) -> Column:
        return every(k, lambda i: F.struct(
            i.alias("pos"), F.xxhash64(F.lit("raw"), *[F.get(F.col("r"), i + j) for j in range(k)]).alias("h"),
            F.lit(None).cast("array<string>").alias("slots"), F.lit(True).alias("ok")))

    found = [template(k) for k in sizes] + [as_is(k) for k in raw]
    return (tagged.select(*keys, "w", F.explode(found[0] if len(found) == 1 else F.concat(*found)).alias("x")).where("x.ok")
            .select(*keys, "x.pos", "x.h", "x.slots", "w"))


def item_windows(benchmark: DataFrame, share: float) -> DataFrame:
    """(item_id, of, raw, size, item_pos, h, own, item_slots, lead, n_item_windows)
    of the items' windows. ``own`` is the hash that counts; a first window
    whose first word is read as a name is a row of its own with that word as
    ``lead``, which the document must hold."""
    texts, keys = keyed(benchmark, "item_id", "of").where("item_id is not null"), ["item_id", "of"]
    every = (windows(texts, keys, [WINDOW], []).withColumn("raw", F.lit(False))
             .unionByName(windows(texts, keys, [], [WINDOW]).withColumn("raw", F.lit(True))))
    every = materialize(every.select(
        "item_id", "of", "raw", F.least(F.size("w"), F.lit(WINDOW)).alias("size"), F.col("pos").alias("item_pos"), "h",
        F.col("h").alias("own"), F.col("slots").alias("item_slots"),
        F.slice(F.col("w"), F.col("pos") + 1, WINDOW).alias("w")).distinct(), "benchmark-all")
    template = every.where("not raw")
    counts = template.groupBy("of").agg(F.countDistinct("h").alias("n_item_windows"))
    # the first word is a name where a text goes before it
    name = F.concat(F.lit(NAME), F.element_at("w", 1))
    word = F.transform("w", lambda x, i: F.when((i == 0) | (x < "\u0004"), F.substring(x, 1, 1)).otherwise(x))
    named = F.transform(word, lambda x, i: F.when(i == 0, F.lit(NAME)).otherwise(x))
    leading = template.where((F.col("item_pos") == 0) & (F.element_at("w", 1) > "\u0004")).select(
        "item_id", "of", "raw", "size", "item_pos", F.xxhash64(*[F.get(named, F.lit(j)) for j in range(WINDOW)]).alias("h"),
        "own", F.concat(F.array(name), F.coalesce("item_slots", F.array().cast("array<string>"))).alias("item_slots"),
        name.alias("lead"))
    template = template.drop("w").withColumn("lead", F.lit(None).cast("string")).unionByName(leading).join(counts, "of")
    # a single window decides where leaving one out goes below the share
    few = counts.where(F.col("n_item_windows") - 1 >= share * F.col("n_item_windows")).select("of")
    exact = every.where("raw").drop("w").withColumn("lead", F.lit(None).cast("string")).join(few, "of", "left_anti")
    n = exact.groupBy("of").agg(F.countDistinct("item_pos").alias("n_item_windows"))
    return materialize(template.unionByName(exact.join(n, "of")), "benchmark-windows")


def keyed(df: DataFrame, key: str, row: str) -> DataFrame:
    """(key, row, text), row a hash of both: rows that repeat an id are told
    apart by their text, and a null id is one of its own."""
    return df.select(F.col(key).cast("long").alias(key), row_of(key).alias(row), "text")


def row_of(key: str):
    id = F.col(key).cast("long")
    return F.xxhash64(id.isNull(), id, F.col("text"))


#: A document's row and an item's row, never null.
PAIR = ["row", "of"]


def judged(pairs: DataFrame, by: list[str], share: float) -> DataFrame:
    """(by, doc_id, item_id, n_windows, n_item_windows, share, consistent) of
    the groups of matching windows that reach ``share``."""
    same = [F.first(c).alias(c) for c in ("doc_id", "item_id", "n_item_windows")]
    found = (pairs.groupBy(*by).agg(F.countDistinct("own").alias("n_windows"), *same)
             .withColumn("share", F.col("n_windows") / F.col("n_item_windows"))
             .where(F.col("share") >= share))
    # slot consistency: an item's value found as itself stands for itself, any
    # other for one value only, and no two for the same
    slots = (pairs.where(F.col("slots").isNotNull() & (F.size("slots") == F.size("item_slots")))
             .select(*by, F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
             .groupBy(*by, F.col("s.item_slots").alias("a"))
             .agg(F.max(F.col("s.item_slots") == F.col("s.slots")).alias("same"),
                  F.min("s.slots").alias("low"), F.max("s.slots").alias("high")))
    clash = (slots.groupBy(*by)
             .agg(F.max(~F.col("same") & (F.col("low") != F.col("high"))).alias("split"), F.count(F.lit(1)).alias("n"),
                  F.countDistinct(F.when(F.col("same"), F.col("a")).otherwise(F.col("low"))).alias("n_values"))
             .where(F.col("split") | (F.col("n_values") < F.col("n")))
             .select(*by, F.lit(True).alias("clash")))
    return found.join(clash, by, "left").select(
        *by, "doc_id", "item_id", "n_windows", "n_item_windows", "share", F.col("clash").isNull().alias("consistent"))


def occurrences(pairs: DataFrame) -> DataFrame:
    """The matches of each possible occurrence, told apart by ``near`` and
    ``anchor``: those of one position difference, and for each difference the
    nearest match of every item window up to half an item away, as values of
    more or fewer words move what follows. Cells keep that join linear."""
    kept = ["doc_id", "item_id", "n_item_windows", "own", "slots", "item_slots"]
    at = pairs.withColumn("diff", F.col("pos") - F.col("item_pos"))
    reach = F.greatest(F.floor(F.col("n_item_windows") / 2), F.lit(1))
    at = at.withColumn("cell", F.floor(F.col("diff") / reach))
    anchors = at.select(*PAIR, F.col("diff").alias("anchor"), F.explode(
        F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell")).distinct()
    away = F.abs(F.col("diff") - F.col("anchor"))
    nearest = (at.join(anchors, [*PAIR, "cell"]).where(away <= reach)
               .groupBy(*PAIR, "anchor", "item_pos")
               .agg(F.min_by(F.struct(*kept), F.struct(away, "diff")).alias("x"))
               .select(*PAIR, F.lit(True).alias("near"), "anchor", "x.*"))
    return at.select(*PAIR, F.lit(False).alias("near"), F.col("diff").alias("anchor"), *kept).unionByName(nearest)


def row_matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(row, doc_id, item_id, n_windows, n_item_windows, share, consistent) for
    the occurrences that reach ``share``, consistent or not. Row identity is the
    id and the text (``keyed``): windows are counted distinct."""
    items = item_windows(benchmark, share)
    widths = [tuple(r) for r in items.select("raw", "size").distinct().collect()]       # at most 2 x WINDOW
    small = items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast if small else (lambda df: df)
    hashes = items.select("h").distinct()
    mine = windows(keyed(docs, "doc_id", "row"), ["doc_id", "row"],
                   sorted({WINDOW, *(k for raw, k in widths if not raw)}), sorted(k for raw, k in widths if raw))
    mine = mine.drop("w")
    # two steps: the documents' windows meet distinct hashes, then items
    hit = materialize(mine.join(side(hashes), "h", "left_semi"), "window-hits")
    met = hit.join(side(items), "h")
    pairs = met.where(~F.col("raw") & (F.col("lead").isNull() | (F.get("slots", F.lit(0)) == F.col("lead"))))
    as_is = (met.where("raw").groupBy(*PAIR, F.expr("pos - item_pos"))
             .agg(F.countDistinct("item_pos").alias("n_windows"),
                  *[F.first(c).alias(c) for c in ("doc_id", "item_id", "n_item_windows")])
             .where("n_windows = n_item_windows")
             .select("row", "doc_id", "item_id", "n_windows", "n_item_windows", F.lit(1.0).alias("share"), F.lit(True).alias("consistent")))
    whole = materialize(judged(pairs, PAIR, share), "whole-texts")
    # single occurrences only where the text as a whole contradicts itself
    open_pairs = whole.where("not consistent").select(*PAIR)
    single = judged(occurrences(pairs.join(open_pairs, PAIR, "left_semi")), [*PAIR, "near", "anchor"], share)
    return whole.unionByName(single.select(*whole.columns)).select(*as_is.columns).unionByName(as_is)


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_windows, n_item_windows, share, consistent) for the
    pairs that reach ``share``, consistent or not; of several occurrences or
    rows with one id the consistent one of the greatest share."""
    best = F.max(F.struct("consistent", "share", "n_windows", "n_item_windows")).alias("best")
    return (row_matches(docs, benchmark, share).groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", "best.n_windows", "best.n_item_windows", "best.share", "best.consistent"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pairs of documents and items that count as contamination."""
    return matches(docs, benchmark).where("consistent").drop("consistent")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no benchmark item. A row is judged by its own text:
    one without an id, or one that shares its id with a contaminated text, goes
    or stays like any other."""
    bad = row_matches(docs, benchmark).where("consistent").select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", row_of("doc_id")).join(bad, "__row", "left_anti").select(*docs.columns)
