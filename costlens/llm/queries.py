"""The queries opN_* over the whole tables, and the pipeline's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm import (chat_format, crf, filter_audit, hilbert, langid, ngram_join, odd_sketch, packing, rindex, spelling,
                          template_decon, topk, train_order)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, with Arrow batches of bounded rows for the Python stages."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _near_sql(n: int, percent: int, more: str = "") -> str:
    """Sets of n-word shingles, links by their similarity, and components."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, words[i:i + {n - 1}] AS gram FROM w, UNNEST(generate_series(1, greatest(len(words) - {n - 1}, 1))) t(i)
  WHERE len(words) > 0),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM g GROUP BY doc_id),
held AS (SELECT gram FROM g GROUP BY gram HAVING COUNT(*) > 1),
h AS (SELECT doc_id, gram FROM g SEMI JOIN held USING (gram)),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM h a JOIN h b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
low AS (SELECT x AS doc_id, MIN(y) AS least FROM reach GROUP BY x)
SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, COALESCE(least, d.doc_id) AS component_id{more}
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN low USING (doc_id)
"""


SQL["op1_ngram_jaccard_join"] = _near_sql(4, 85)
SQL["op12_odd_sketch_dedup"] = _near_sql(5, 85, ", d.doc_id = COALESCE(least, d.doc_id) AS kept")
SQL["op5_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op2_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(said).alias("text"))
    return chat_format.read_back(chat_format.format_chat(turns.unionByName(extra)))


@query
def op3_hilbert_shards(spark, sf_dir):
    out = hilbert.shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "hilbert")


@query
def op4_training_order(spark, sf_dir):
    out = train_order.scratch_uri(spark, "training-order")
    manifest = train_order.write_training_order(table(spark, sf_dir, "documents"), out)
    read = train_order.read_slots(manifest, out)
    return read.select("doc_id", "seq", "n_tokens", "shard", "record", "slot", "ids_crc32",
                       F.crc32("ids").alias("read_crc32"))


@query
def op5_exact_top_k(spark, sf_dir):
    return topk.search_every(table(spark, sf_dir, "embeddings"))


@query
def op6_run_length_dedup(spark, sf_dir):
    return rindex.removal_digest(table(spark, sf_dir, "documents"))


@query
def op7_toxicity_crf(spark, sf_dir):
    return crf.toxicity_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted", "n_spans", "spans")


@query
def op8_language_spans(spark, sf_dir):
    return langid.language_of_documents(table(spark, sf_dir, "documents"), with_spans=True).select(
        "doc_id", "held_out", "lang_pred", "score", "n_spans", "spans")


@query
def op9_template_decontamination(spark, sf_dir):
    return template_decon.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_column_generation_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op11_filter_audit"] = """
WITH d AS (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
least AS (SELECT text, MIN(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, MAX(CAST(quality = 1 AS INT)) AS good, MAX(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic, MAP {
  'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
  'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
  'D': regexp_matches(text, '[#$%&*|]'), 'E': COALESCE(w.doc_id > first, FALSE)} AS fails
  FROM w JOIN least USING (text) LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, fails, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM f GROUP BY ALL),
parts AS (SELECT DISTINCT part FROM d),
x AS (SELECT UNNEST(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[:step - 1], '') AS before
  FROM orders, (SELECT UNNEST([1, 2, 3, 4, 5]) AS step)),
got AS (SELECT s.filter_order, s.step, s.own, c.part, c.n, c.good, c.toxic, c.fails[s.own] AS out,
  len(list_filter(s.before, lambda b: b <> '' AND c.fails[b])) = 0 AS here,
  len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda b: c.fails[b])) = 1 AS lone FROM steps s, cells c),
told AS (SELECT part, filter_order, step, own, COALESCE(SUM(n) FILTER (here AND NOT out), 0) AS kept,
  COALESCE(SUM(n) FILTER (here AND out), 0) AS removed, COALESCE(SUM(n) FILTER (out AND NOT here), 0) AS redundant,
  COALESCE(SUM(n) FILTER (out AND lone), 0) AS unique_fails, COALESCE(SUM(good) FILTER (here AND out), 0) AS good_lost,
  COALESCE(SUM(toxic) FILTER (here AND out), 0) AS toxic_lost FROM got GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM told
"""


@query
def op12_odd_sketch_dedup(spark, sf_dir):
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), 5, 85)


@query
def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
