"""The five corpus tables: schemas, Parquet and JDBC readers and writers, and the adapter of the generated tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = "text_id long, title string, author string, year int, genre string"
SENTENCES = "sentence_id long, sentence string, text_id long"
TOKENS = "token_id long, token string, text_id long, token_count long"
WORDS = "word_id long, token_id long, word string, pos string, frequency long, text_id long"
CROSS = "cross_id long, word_id long, sentence_id long, text_id long, token_id long"
SCHEMAS = {"texts": TEXTS, "sentences": SENTENCES, "tokens": TOKENS, "words": WORDS, "cross": CROSS}


@dataclass(frozen=True)
class Corpus:
    """Five lazy tables. A token belongs to one text; ``cross`` has one row per occurrence, repeats allowed."""

    texts: DataFrame
    sentences: DataFrame
    tokens: DataFrame
    words: DataFrame
    cross: DataFrame


def read_corpus(spark: SparkSession, path: str) -> Corpus:
    return Corpus(**{name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()})


def write_corpus(corpus: Corpus, path: str, mode: str = "errorifexists") -> None:
    for f in fields(Corpus):
        getattr(corpus, f.name).write.mode(mode).parquet(f"{path}/{f.name}")


def _bucketed_name(path: str, name: str) -> str:
    return f"corpus_{hashlib.md5(path.encode()).hexdigest()}_{name}"


def write_corpus_bucketed(corpus: Corpus, path: str, buckets: int = 16) -> None:
    """The tables as external bucketed ones under ``path``, each in the same number of buckets by text and sorted by it. What is joined or grouped by text
    isn't shuffled when it is read with ``read_corpus_bucketed``; for joins on text and token, too, the session needs
    ``spark.sql.requireAllClusterKeysForCoPartition`` set to false."""
    for f in fields(Corpus):
        rows = getattr(corpus, f.name).repartition(buckets, "text_id").sortWithinPartitions("text_id")
        rows.write.bucketBy(buckets, "text_id").sortBy("text_id").option("path", f"{path}/{f.name}").format("parquet").saveAsTable(_bucketed_name(path, f.name))


def read_corpus_bucketed(spark: SparkSession, path: str, buckets: int = 16) -> Corpus:
    """The same tables in any session: files tell their buckets by their names, so all that is made here is the entry in the session's catalog."""
    for name, schema in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {_bucketed_name(path, name)} ({schema}) USING parquet CLUSTERED BY (text_id) SORTED BY (text_id) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
    return Corpus(**{name: spark.table(_bucketed_name(path, name)) for name in SCHEMAS})


def write_corpus_jdbc(corpus: Corpus, url: str, properties: dict[str, str], connections: int = 8, mode: str = "errorifexists", names: dict[str, str] | None = None) -> None:
    """The tables into a relational database, over at most ``connections`` connections at a time; ``names`` has other names of tables, such
    as quoted ones where ``cross`` is a reserved word. What a failed task wrote before it failed isn't taken back by the database, so
    write to empty tables and check the counts, or append under a unique key."""
    for f in fields(Corpus):
        getattr(corpus, f.name).write.option("numPartitions", connections).jdbc(url, (names or {}).get(f.name, f.name), mode=mode, properties=properties)


def jdbc_bounds(spark: SparkSession, url: str, properties: dict[str, str], names: dict[str, str] | None = None, rows_a_task: int = 1_000_000, column: str = '"text_id"') -> dict[str, tuple[str, int, int, int]]:
    """Bounds for ``read_corpus_jdbc``: the database tells the least and largest text id and the number of rows of each table; a table of few rows has none.
    ``column`` is the text id as the database quotes names; Spark's writer keeps small letters."""
    out = {}
    for name in SCHEMAS:
        asked = f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi, COUNT(*) AS n FROM {(names or {}).get(name, name)}) b"
        lo, hi, n = spark.read.jdbc(url, asked, properties=properties).first()
        parts = -(-n // rows_a_task)
        if parts > 1 and lo is not None and hi > lo:
            out[name] = ("text_id", lo, hi, parts)
    return out


def read_corpus_jdbc(
    spark: SparkSession, url: str, properties: dict[str, str], bounds: dict[str, tuple[str, int, int, int]] | None = None, names: dict[str, str] | None = None, rows_a_task: int = 1_000_000
) -> Corpus:
    """The tables from a relational database; ``bounds`` names per table the partition column, its lowest and highest value and the
    number of partitions. Credentials come from the caller's ``properties``. A table without bounds is read by one task; where ``bounds`` is left out, the
    database is asked for them, so that tasks have some ``rows_a_task`` each where ids are dense."""
    bounds = jdbc_bounds(spark, url, properties, names, rows_a_task) if bounds is None else bounds
    out = {}
    for name in SCHEMAS:
        table = (names or {}).get(name, name)
        if name in bounds:
            column, low, high, parts = bounds[name]
            out[name] = spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)
        else:
            out[name] = spark.read.jdbc(url, table, properties=properties)
    return Corpus(**out)


def spread(texts: DataFrame) -> DataFrame:
    """Texts dealt out by id where their files make fewer parts than the cluster has cores; a table of many files stays as it is, unshuffled."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores, "text_id") if texts.rdd.getNumPartitions() < cores else texts


def texts_from_documents(documents: DataFrame) -> DataFrame:
    """Generated ``documents`` as texts with their raw text; year is made up from the id."""
    return documents.select(
        F.col("doc_id").alias("text_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("author"),
        (F.lit(1800) + F.col("doc_id") % 200).cast("int").alias("year"),
        F.col("lang").alias("genre"),
        "text",
    )
