"""The corpus pipeline: toxicity, near duplicates, personal data, mixing and packing, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import mixing, near_dups, packing, pii, pii_labels, toxicity
from wordloom.llm.common import cut, forget, shared_folder, table
from wordloom.llm.queries import labelled, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the cutoff. The classifier is trained on the labelled documents of the table as it came in."""
    labels = table(spark, sf_dir, "labels")
    rows = cut(labelled(docs, labels, held_out=False))
    model = toxicity.train(rows)
    forget(rows)
    return toxicity.keep(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the least doc_id. Of repeated rows of one doc_id the least stays, by the columns in order."""
    kept = near_dups.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    nulls = docs.select(*COLUMNS).filter("doc_id is null")
    own = docs.select(*COLUMNS).filter("doc_id is not null")
    rows = own.join(kept, own["doc_id"] == F.col("_id"), "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r"))
    return rows.select("doc_id", "r.*").unionByName(nulls)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with found spans replaced by their kind; n_chars is that of the new text."""
    field = pii.train(pii_labels.labelled_table())
    return pii.redacted(docs.select(*COLUMNS), field).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mixed(docs.select(*COLUMNS))
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Training, hashing of sets, a random field and a tokenizer aren't SQL; tests/llm does all stages again on lists.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
