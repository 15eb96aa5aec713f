"""One query for each operator, over whole tables with production parameters, and SQL where it can express it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html_extract, media, mixing, near_dups, packing, pii, pii_labels, quality, toxicity, url_filter, url_labels
from .common import cut, forget, table

#: Folder of public vocabulary files.
TOKENIZERS = os.environ.get("WORDLOOM_TOKENIZERS", "")


def tokenizer_path(name: str = "word_bpe_49k.json", folder: str = TOKENIZERS) -> str:
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_labels.labelled_urls())
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed_sizes(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def labelled(docs: DataFrame, labels: DataFrame, held_out: bool = True) -> DataFrame:
    """doc_id, text, toxic of a bounded sample of labelled documents; without those whose crc32(doc_id) mod 4 is 2, if they are held out."""
    labels = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_out:
        labels = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return toxicity.training_rows(docs, labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = cut(labelled(docs, table(spark, sf_dir, "labels")))
    model = toxicity.train(rows)
    forget(rows)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", "predicted")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op7_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of embeddings drawn as images, since the tables hold no media: vec_id, n_corners, component_id, n_links."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    images = vectors.mapInPandas(media.thumbnails, "id long, height int, width int, pixels binary")
    return media.image_copies(images).withColumnRenamed("id", "vec_id")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    back = chat.read_back(chat.format_conversations(rows.unionByName(own)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = back.withColumn("_loss", chat.text_under_loss(F.col("formatted"), F.col("loss_runs")))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(whole).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), digest(F.col("_loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), pii.train(pii_labels.labelled_table())).drop("redacted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = cut(quality.statistics(docs).drop("text"))
    rules = quality.train(stats, table(spark, sf_dir, "labels"))
    return quality.judge(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


QUERIES = {f.__name__: f for f in (op1_main_text, op2_url_filter, op3_packing, op4_mixing, op5_toxicity, op6_near_duplicates, op7_media_copies, op8_chat_format, op9_pii, op10_quality_rules)}


_ESCAPED = "replace(replace(replace({0}, '\\', '\\b'), '<', '\\l'), '>', '\\g')"

_OP8 = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), turns AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before_ FROM rows_
), counted AS (
  SELECT *, length({_ESCAPED.format('text')}) + length({_ESCAPED.format('role')}) + 7 + CASE WHEN before_ IS NULL OR before_ = role THEN 0 ELSE 7 END AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + 7 AS BIGINT) AS formatted_chars
FROM counted GROUP BY conv_id"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs that share a shingle, and the closure of their links: for small tables only.
_OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.c + b.c - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.y, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id"""

#: SQL where it can express the whole result. The others are tested against brute-force versions in tests/llm.
ORACLE_SQL = {"op6_near_duplicates": _OP6, "op8_chat_format": _OP8}


def oracle_sql() -> dict[str, str]:
    """ORACLE_SQL with the url trees, which are trained for it, as SQL."""
    return {**ORACLE_SQL, "op2_url_filter": url_filter.judge_sql(url_filter.train(url_labels.labelled_urls()), "pages", "page_id")}
