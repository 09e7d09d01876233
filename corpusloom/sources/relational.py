"""Replacing the five tables in a relational database: staged first, checked, then switched in one transaction of the database."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import SparkSession

from corpusloom.sources.corpus import SCHEMAS, Corpus


class StagingError(RuntimeError):
    """A staged table doesn't hold the rows that were written; nothing has been switched."""


def _connection(spark: SparkSession, url: str, properties: dict[str, str]):
    jvm = spark._jvm
    held = jvm.java.util.Properties()
    for key, value in properties.items():
        held.setProperty(key, value)
    # the loader that Spark's own tasks use, so that drivers shipped with the job are found
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    driver = jvm.java.lang.Class.forName(properties["driver"], True, loader).getDeclaredConstructor(spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 0))
    return driver.newInstance(spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0)).connect(url, held)


def replace_corpus_jdbc(spark: SparkSession, corpus: Corpus, url: str, properties: dict[str, str], connections: int = 8, names: dict[str, str] | None = None, staged: str = "corpus_staged_") -> dict[str, int]:
    """The rows of the five tables in the database become those of ``corpus``, all at once; returns the rows of each table.

    Tasks write to tables of their own, whose names begin with ``staged``; what an interrupted run left there is written over. Their rows are held against those of the
    frames, which are counted beside, so read them from files: a task that failed after its commit and was run again shows there. Then the database deletes the old rows and takes in the staged ones in one transaction, so
    readers see the old tables or the new ones, and whatever fails leaves the old ones. The tables must be there (``write_corpus_jdbc`` makes them), with the columns
    of the corpus in any order and case; foreign keys between them hold, parents go in first and out last. ``properties`` names the driver's class. One run at a time for a prefix.
    """
    tables = {name: (names or {}).get(name, name) for name in SCHEMAS}
    rows = {}
    for f in fields(Corpus):
        frame = getattr(corpus, f.name)
        frame.write.option("numPartitions", connections).jdbc(url, f"{staged}{f.name}", mode="overwrite", properties=properties)
        rows[f.name] = frame.count()  # Spark's writer to databases reports no observed metrics
        there = spark.read.jdbc(url, f"(SELECT COUNT(*) AS n FROM {staged}{f.name}) c", properties=properties).first()[0]
        if there != rows[f.name]:
            raise StagingError(f"{staged}{f.name} holds {there} rows of {rows[f.name]}; run again")
    moved = {}
    for name, table in tables.items():
        own = {c.lower(): c for c in spark.read.jdbc(url, table, properties=properties).columns}
        moved[name] = [(own[c.lower()], c) for c in getattr(corpus, name).columns]
    connection = _connection(spark, url, properties)
    try:
        connection.setAutoCommit(False)
        mark = connection.getMetaData().getIdentifierQuoteString().strip()
        listed = lambda columns: ", ".join(f"{mark}{c}{mark}" for c in columns)
        work = [f"DELETE FROM {tables[name]}" for name in reversed(SCHEMAS)]
        work += [f"INSERT INTO {tables[name]} ({listed(a for a, _ in moved[name])}) SELECT {listed(b for _, b in moved[name])} FROM {staged}{name}" for name in SCHEMAS]
        statement = connection.createStatement()
        try:
            for sql in work:
                statement.executeUpdate(sql)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        for name in SCHEMAS:
            statement.executeUpdate(f"DROP TABLE {staged}{name}")
        connection.commit()
    finally:
        connection.close()
    return rows
