"""Replacing the tables of a database: what fails before or in the switch leaves the old rows whole (Derby)."""

from dataclasses import replace

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.sources import corpus, relational

NAMES = {"cross": '"cross"'}


def small(spark, n, word="w"):
    ids = spark.range(1, n + 1).withColumnRenamed("id", "i")
    return corpus.Corpus(
        texts=ids.select(F.col("i").alias("text_id"), F.format_string("t%d", "i").alias("title"), F.lit("a").alias("author"), F.lit(1900).alias("year"), F.lit(None).cast("string").alias("genre")),
        sentences=ids.select((F.col("i") * 10).alias("sentence_id"), F.lit(f"{word} o'clock").alias("sentence"), F.col("i").alias("text_id")),
        tokens=ids.select((F.col("i") * 100).alias("token_id"), F.lit(word).alias("token"), F.col("i").alias("text_id"), F.lit(1).cast("long").alias("token_count")),
        words=spark.createDataFrame([], corpus.WORDS),
        cross=ids.select("i", (F.col("i") * 7).alias("word_id"), (F.col("i") * 10).alias("sentence_id"), F.col("i").alias("text_id"), (F.col("i") * 100).alias("token_id")).withColumnRenamed("i", "cross_id"),
    )


def rows_of(spark, url, driver):
    back = corpus.read_corpus_jdbc(spark, url, driver, {}, NAMES)
    return {name: sorted(map(tuple, getattr(back, name).collect()), key=str) for name in corpus.SCHEMAS}


def expected(c):
    return {name: sorted(map(tuple, getattr(c, name).collect()), key=str) for name in corpus.SCHEMAS}


@pytest.fixture()
def database(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    old = small(spark, 5)
    corpus.write_corpus_jdbc(old, url, driver, connections=2, names=NAMES)
    return url, driver, expected(old)


def test_all_tables_are_replaced_at_once(spark, database):
    url, driver, old = database
    assert rows_of(spark, url, driver) == old
    for n, word in ((30, "new"), (3, "less"), (0, "none")):
        new = small(spark, n, word)
        assert relational.replace_corpus_jdbc(spark, new, url, driver, 2, NAMES) == {"texts": n, "sentences": n, "tokens": n, "words": 0, "cross": n}
        assert rows_of(spark, url, driver) == expected(new)


def test_a_failing_task_leaves_the_old_rows(spark, database):
    url, driver, old = database
    new = small(spark, 30, "new")
    broken = replace(new, cross=new.cross.withColumn("word_id", F.when(F.col("cross_id") == 29, F.raise_error(F.lit("lost"))).otherwise(F.col("word_id")).cast("long")))
    with pytest.raises((PySparkException, Py4JJavaError)):
        relational.replace_corpus_jdbc(spark, broken, url, driver, 2, NAMES)
    assert rows_of(spark, url, driver) == old
    relational.replace_corpus_jdbc(spark, new, url, driver, 2, NAMES)  # over what was staged before the failure
    assert rows_of(spark, url, driver) == expected(new)


def test_a_failing_switch_leaves_the_old_rows(spark, database):
    url, driver, old = database
    connection = relational._connection(spark, url, driver)
    connection.createStatement().executeUpdate('ALTER TABLE "cross" ADD CONSTRAINT few CHECK ("cross_id" < 20)')
    connection.close()
    with pytest.raises(Py4JJavaError, match="FEW"):
        relational.replace_corpus_jdbc(spark, small(spark, 30), url, driver, 2, NAMES)
    assert rows_of(spark, url, driver) == old


def test_rows_that_are_staged_twice_are_noticed(spark, database, monkeypatch):
    url, driver, old = database
    new = small(spark, 4)
    monkeypatch.setattr(type(new.texts), "count", lambda df: 3)
    with pytest.raises(relational.StagingError):
        relational.replace_corpus_jdbc(spark, new, url, driver, 2, NAMES)
    monkeypatch.undo()
    assert rows_of(spark, url, driver) == old
