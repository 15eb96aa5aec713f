"""Readers and writers of the text formats of the workload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import islands, ranked, sentence_tokens, strip


def labelled_pairs(spark: SparkSession, path: str, numeric: bool = True) -> DataFrame:
    """score, first, second of a tab-separated file; # lines are skipped, texts trimmed and in lower case. Bad rows fail."""
    kind = "DOUBLE" if numeric else "STRING"
    raw = spark.read.schema(f"score {kind}, first STRING, second STRING").option("mode", "FAILFAST").csv(path, sep="\t", comment="#", quote="")
    return raw.select("score", *[F.lower(strip(F.col(c))).alias(c) for c in ("first", "second")])


def attack_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, header of the files whose first line names their attacks."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("header"))
    return lines.filter(F.col("header").startswith("# ["))


def fields(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """path, fields: all lines, split, as they stand."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split("value", sep).alias("fields"))


def tokenized(spark: SparkSession, path: str) -> DataFrame:
    """path, fields: all lines, split at tabs, each field as its tokens."""
    return fields(spark, path).withColumn("fields", F.transform("fields", sentence_tokens))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(~F.col("value").startswith("#!comment:")).select(F.col("value").alias("word"))


def word_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word STRING, freq BIGINT").csv(path, sep=" ", quote="")


def pronunciations(spark: SparkSession, path: str, frequencies: DataFrame | None = None) -> DataFrame:
    """word, letters, phones (aligned) and freq (1 without frequencies (word, freq)) of lines l|l|...<tab>p|p|...|, as phonetic.statistics takes them."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    piece = lambda i: F.filter(F.split(F.col("p")[i], r"\|"), lambda x: x != "")
    out = parts.select(F.array_join(piece(0), "").alias("word"), piece(0).alias("letters"), piece(1).alias("phones"))
    if frequencies is None:
        return out.withColumn("freq", F.lit(1).cast("long"))
    return out.join(frequencies.select("word", F.col("freq").cast("long").alias("freq")), "word", "left").fillna(1, ["freq"])


def stimuli(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.schema("stimulus STRING, Truth STRING, Class STRING").csv(path, sep=sep, header=True)


def questionnaire(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vp STRING, question STRING, answer STRING").csv(path)


def trials(spark: SparkSession, path: str) -> DataFrame:
    """vp and the fields of the record in the fourth column, read as JSON by schema and never evaluated."""
    schema = "phase STRING, status STRING, cond STRING, sent STRING, cleanSent STRING, response STRING, attack STRING"
    raw = spark.read.schema("vp STRING, a STRING, b STRING, trial STRING").csv(path, quote='"', escape='"')
    return raw.select("vp", F.from_json("trial", schema, {"allowSingleQuotes": "true"}).alias("t")).select("vp", "t.*")


def tuning_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """word, vector of lines "word v1 v2 ..."; the head line with two numbers is skipped."""
    p = spark.read.text(path).select(F.split(F.rtrim("value"), " ").alias("p")).filter(F.size("p") > 2)
    return p.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: x.cast("double")).alias("vector"))


def conll(lines: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    return islands(lines, key, order, text)


def perturbation_store(spark: SparkSession, path: str) -> DataFrame:
    """key, values (a set) of lines "key<tab>v1 v2 ..."; repeated keys are merged."""
    p = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    return p.select(F.col("p")[0].alias("key"), F.explode(F.split(F.col("p")[1], " ")).alias("v")).groupBy("key").agg(F.sort_array(F.collect_set("v")).alias("values"))


def write_store(store: DataFrame, path: str) -> None:
    """A perturbation store (key, values) as text."""
    store.select(F.concat_ws("\t", "key", F.array_join("values", " ")).alias("value")).write.mode("error").text(path)


def added(store: DataFrame, new: DataFrame) -> DataFrame:
    """A store with new observations (key, value)."""
    rows = store.select("key", F.explode("values").alias("v")).unionByName(new.select("key", F.col("value").alias("v")))
    return rows.groupBy("key").agg(F.sort_array(F.collect_set("v")).alias("values"))


def observed(words: DataFrame, store: DataFrame, key: str, value: str) -> DataFrame:
    """words with seen: whether the store has the value under the key."""
    flat = store.select(F.col("key").alias(key), F.explode("values").alias(value), F.lit(True).alias("seen"))
    return words.join(flat, [key, value], "left").fillna(False, ["seen"])


def without(df: DataFrame, column: str, part: str) -> DataFrame:
    """The rows whose column doesn't contain the part; nulls stay."""
    return df.filter(~F.coalesce(F.contains(F.col(column), F.lit(part)), F.lit(False)))


def base_name(path: Column) -> Column:
    """The name of a file without folder and extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def write_indexed(df: DataFrame, order: str, column: str, path: str) -> None:
    """index (from 0 by order) and column as tab-separated text with a header."""
    ordered = ranked(df.select(order, F.col(column).alias("sentence")).withColumn("_one", F.lit(0)).withColumn("_key", F.lpad(F.col(order).cast("string"), 20, "0")), "_one", "_key", prefix=17)
    ordered.select(F.col("rank").alias("index"), "sentence").write.option("sep", "\t").option("header", True).mode("error").csv(path)


def write_attacked(pairs: DataFrame, header: str, path: str) -> None:
    """Attacked pairs (score, first, second), and their attacks as a table of its own, in two folders below path."""
    write_pairs(pairs, f"{path}/pairs")
    pairs.sparkSession.createDataFrame([(header,)], "header string").coalesce(1).write.mode("error").text(f"{path}/header")


def solved_or_stored(spark: SparkSession, path: str, solve) -> DataFrame:
    """The table at path; where there is none yet, that of solve(), written there first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        solve().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_pairs(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """score, first, second as tab-separated text, in folders by method and attack if these are given."""
    writer = df.write.option("sep", "\t").option("quote", "").mode("error")
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_tokens(df: DataFrame, tokens: str, path: str, as_sentences: bool = True) -> None:
    df.select(F.array_join(F.col(tokens), " " if as_sentences else "\t").alias("value")).write.mode("error").text(path)


def unfinished(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The jobs whose result isn't there yet."""
    return jobs.join(done.select(key), key, "left_anti")
