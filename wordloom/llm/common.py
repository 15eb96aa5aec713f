"""What the corpus operators share: word rules, cutting of lineage, reading of tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def ascii_lower(text: str) -> str:
    """A-Z in lower case, nothing else; by way of bytes, which is much faster than translate()."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[str]:
    """The words of a text by :data:`WORD`; none for null."""
    if not text:
        return []
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def n_words(text: Column) -> Column:
    """Number of words by :data:`WORD`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder in spark.checkpoint.dir. Where the setting is absent, a temporary one in local mode (tests); a cluster without it is refused."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wordloom-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the session's checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, **measures: Column) -> DataFrame:
    """df, written to the shared folder as Parquet and read again, so that a lost executor costs no recomputation.

    Compressed columns take a fraction of what checkpoint() writes. :func:`forget` removes a table early; the others
    stay until the owner of the folder clears it. measures are aggregates of the written rows; :func:`measured` has them.
    """
    path, seen = shared_folder(df.sparkSession, "cut"), Observation() if measures else None
    (df.observe(seen, *[c.alias(n) for n, c in measures.items()]) if measures else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut, out._measured = path, seen.get if measures else {}
    return out


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df from :func:`cut`, and its number of rows, counted on the way."""
    out = cut(df, rows=F.count(F.lit(1)))
    return out, out._measured["rows"]


def measured(df: DataFrame) -> dict:
    return df._measured


def forget(*tables: DataFrame) -> None:
    """Removes the tables of frames from :func:`cut` that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._cut)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, columns: list[str]) -> str:
    """A column name like name that isn't among columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
