"""A stored corpus with versions: bucketed files, and manifests that name the files of each version.

Every table is written in buckets of texts. What changes is staged as new files first; then one manifest is written that names all files
of the next version, and from that moment on readers see it. A job that dies before has changed nothing, and what it staged is in no manifest. Files are
never overwritten, so each version stays readable.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import maintain
from corpusloom.sources.corpus import SCHEMAS, Corpus

BUCKETS = 16
MANIFEST = "name string, bucket int, file string, rows long, buckets int"


class Conflict(RuntimeError):
    """Somebody else has committed a version meanwhile; what was staged is in no manifest. Read the new version and try again."""


@dataclass(frozen=True)
class Version:
    """One version: its number, its buckets, its files as (table, bucket, file), and the rows of each table, counted while they were written."""

    path: str
    number: int
    buckets: int
    files: tuple[tuple[str, int, str], ...]
    rows: dict[str, int]

    def table(self, spark: SparkSession, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table, or some buckets of it: other files aren't opened."""
        found = [f for n, b, f in self.files if n == name and (buckets is None or b in buckets)]
        return spark.read.schema(SCHEMAS[name]).parquet(*found) if found else spark.createDataFrame([], SCHEMAS[name])

    def corpus(self, spark: SparkSession, touched: dict[str, set[int]] | None = None) -> Corpus:
        return Corpus(**{name: self.table(spark, name, None if touched is None else touched.get(name, set())) for name in SCHEMAS})


def bucket_of(buckets: int, column: str = "text_id") -> Column:
    return F.pmod(F.hash(column), F.lit(buckets))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    try:
        return sorted(r.v for r in spark.read.schema(f"{MANIFEST}, v int").parquet(f"{path}/versions").select("v").distinct().collect())
    except AnalysisException:
        return []


def read_version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The version of that number, or the latest."""
    known = versions(spark, path)
    if not known or (number is not None and number not in known):
        raise ValueError(f"no version {number or ''} under {path}")
    number = known[-1] if number is None else number
    # a manifest is as long as Spark's own listing of the files
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/versions/v={number}").collect()
    files = tuple(sorted((r.name, r.bucket, r.file) for r in rows if r.file is not None))
    return Version(path, number, rows[0].buckets, files, {r.name: r.rows for r in rows if r.file is None})


def read_store(spark: SparkSession, path: str, number: int | None = None) -> Corpus:
    return read_version(spark, path, number).corpus(spark)


def counted(df: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """``df`` that counts its rows while whatever writes it runs, and what to call afterwards for their number: no job of its own counts them."""
    seen = Observation()

    def rows() -> int:
        try:
            return seen.get["rows"]
        except Py4JJavaError:
            # adaptive execution found the frame empty and left out the counting with it; otherwise it counts here
            return df.count()

    return df.observe(seen, F.count(F.lit(1)).alias("rows")), rows


def _staged(df: DataFrame, path: str, name: str, buckets: int) -> tuple[list[tuple[str, int, str]], int]:
    """Writes rows of one table as new files, sorted by text in their buckets: (files, rows)."""
    at = f"{path}/data/{uuid.uuid4().hex}/{name}"
    rows, seen = counted(df.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]))
    dealt = rows.withColumn("text_bucket", bucket_of(buckets)).repartition("text_bucket", F.pmod(F.xxhash64("text_id"), F.lit(8))).sortWithinPartitions("text_bucket", "text_id")
    dealt.write.partitionBy("text_bucket").parquet(at)
    n = seen()
    if not n:
        return [], 0
    files = df.sparkSession.read.schema(SCHEMAS[name]).parquet(at).inputFiles()
    return [(name, int(f.split("/text_bucket=")[1].split("/")[0]), f) for f in files], n


def _commit(spark: SparkSession, path: str, base: int, buckets: int, files: list[tuple[str, int, str]], rows: dict[str, int]) -> Version:
    """One manifest of one file, which appears by a rename; a version that somebody else has committed since ``base`` is a conflict."""
    lines = [(n, b, f, None, buckets) for n, b, f in files] + [(n, None, None, rows[n], buckets) for n in SCHEMAS]
    number = base + 1
    while True:
        try:
            spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{path}/versions/v={number}")
            return Version(path, number, buckets, tuple(sorted(files)), rows)
        except AnalysisException as exists:
            if max(versions(spark, path), default=0) > base:
                raise Conflict(f"version {number} of {path} was committed meanwhile") from exists
            if number > base + 100:
                raise
            number += 1  # a folder that somebody left without a manifest


def create_store(spark: SparkSession, corpus: Corpus, path: str, buckets: int = BUCKETS) -> Version:
    """The first version."""
    if versions(spark, path):
        raise ValueError(f"{path} has versions already")
    staged = {f.name: _staged(getattr(corpus, f.name), path, f.name, buckets) for f in fields(Corpus)}
    return _commit(spark, path, 0, buckets, [f for found, _ in staged.values() for f in found], {name: n for name, (_, n) in staged.items()})


def append(spark: SparkSession, base: Version, **tables: DataFrame) -> Version:
    """The next version: all files of ``base`` and new ones. Nothing that is stored is read or written again; without new rows ``base`` stays the latest."""
    staged = {name: _staged(df, base.path, name, base.buckets) for name, df in tables.items()}
    new = [f for found, _ in staged.values() for f in found]
    if not new:
        return base
    rows = {name: n + (staged[name][1] if name in staged else 0) for name, n in base.rows.items()}
    return _commit(spark, base.path, base.number, base.buckets, [*base.files, *new], rows)


def _rewritten(spark: SparkSession, base: Version, touched: dict[str, set[int]], left: Corpus) -> Version:
    """The next version: touched buckets as they are in ``left``, the other files as they are."""
    files, rows = [f for f in base.files if f[1] not in touched.get(f[0], ())], dict(base.rows)
    for name, buckets in touched.items():
        if buckets:
            before, seen = counted(base.table(spark, name, buckets))
            before.select(F.lit(1)).write.format("noop").mode("overwrite").save()
            found, n = _staged(getattr(left, name), base.path, name, base.buckets)
            files += found
            rows[name] += n - seen()
    return _commit(spark, base.path, base.number, base.buckets, files, rows) if any(touched.values()) else base


def _buckets_of(rows: DataFrame, buckets: int) -> set[int]:
    """The buckets that the texts of these rows lie in; there are no more than ``buckets``."""
    return {r.b for r in rows.select(bucket_of(buckets).alias("b")).distinct().collect()}


def drop_stored_texts(spark: SparkSession, path: str, gone: DataFrame) -> Version:
    """Without the texts of ``gone(text_id)`` and all that hangs on them; only buckets that hold something of them are written anew."""
    base = read_version(spark, path)
    whole, ids = base.corpus(spark), gone.select("text_id").distinct()
    own = _buckets_of(whole.texts.join(ids, "text_id", "left_semi").select("text_id").unionByName(whole.sentences.join(ids, "text_id", "left_semi").select("text_id")).unionByName(whole.tokens.join(ids, "text_id", "left_semi").select("text_id")), base.buckets)
    parts = base.corpus(spark, {n: own for n in SCHEMAS})
    hanging = whole.cross.join(ids, "text_id", "left_semi").select("text_id")
    for side, key in ((parts.tokens, "token_id"), (parts.sentences, "sentence_id")):
        hanging = hanging.unionByName(whole.cross.join(side.join(ids, "text_id", "left_semi").select(key), key, "left_semi").select("text_id"))
    touched = {n: own for n in ("texts", "sentences", "tokens")} | {"words": _buckets_of(whole.words.join(ids, "text_id", "left_semi"), base.buckets), "cross": _buckets_of(hanging, base.buckets)}
    touched = {n: b & {f[1] for f in base.files if f[0] == n} for n, b in touched.items()}
    return _rewritten(spark, base, touched, maintain.drop_texts(replace(parts, words=base.table(spark, "words", touched["words"]), cross=base.table(spark, "cross", touched["cross"])), ids))


def remove_stored_occurrences(spark: SparkSession, path: str, entries: DataFrame) -> Version:
    """Without as many cross rows of each (token_id, sentence_id, word_id) as ``entries`` lists it; counts of their tokens are lowered."""
    base = read_version(spark, path)
    whole = base.corpus(spark)
    hit = whole.cross.join(entries.select("token_id", "sentence_id", "word_id").distinct(), ["token_id", "sentence_id", "word_id"], "left_semi")
    return _removed(spark, base, hit, lambda c: maintain.remove_occurrences(c, entries))


def remove_stored_cross(spark: SparkSession, path: str, token_id: int, cross_ids: DataFrame) -> Version:
    """Without the cross rows named in ``cross_ids(cross_id string)``; the count of the one token is lowered."""
    base = read_version(spark, path)
    ids = cross_ids.select(F.expr("try_cast(cross_id as bigint)").alias("cross_id"))
    hit = base.table(spark, "cross").join(ids, "cross_id", "left_semi")
    return _removed(spark, base, hit.withColumn("token_id", F.lit(token_id).cast("long")), lambda c: maintain.remove_cross(c, token_id, cross_ids))


def _removed(spark: SparkSession, base: Version, hit: DataFrame, change) -> Version:
    tokens = base.table(spark, "tokens").join(hit.select("token_id").distinct(), "token_id", "left_semi")
    touched = {"cross": _buckets_of(hit, base.buckets), "tokens": _buckets_of(tokens, base.buckets)}
    return _rewritten(spark, base, touched, change(base.corpus(spark, touched)))
