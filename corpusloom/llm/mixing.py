"""Mixing sources to target weights by hash-threshold histograms, without sorting and without Python workers.

Every document gets a 60-bit hash of its id. Per source, word counts are summed by the leading hash bits; the bucket in
which the running sum meets the budget is the only one that is looked at again, by its next bits. The thresholds of
growing budgets are nested: a document that a smaller budget takes is in every larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, text_of
from corpusloom.sources.shared import materialise

BITS, LEVELS = 10, 6  # six levels of 1,024 buckets resolve all 60 bits
#: Rows of the per-source table up to which it is broadcast (under 100 bytes each).
BROADCAST_SOURCES = 100_000


def id_hash(column: str = "doc_id") -> Column:
    """60 leading bits of the MD5 of the id as text, as a long; null ids hash as the empty text."""
    digest = F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_of(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        id_hash(id_col).alias("h"),
    )


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target) for each source.

    Sources in code-point order, null last, get the weights in turn. ``share`` times all words are shared by weight; a
    target stops at ``limit`` times its source, and what is over goes to the others by weight. The level at which that
    settles is read off running sums over sources ordered by size per weight: one row per source, no rows of documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(limit)))
    by_need = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("full", F.coalesce(F.sum("most").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("all_words") * F.lit(float(share)) - F.col("full")) / F.col("open"))
    )
    settled = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything)
    return per.select("source", "source_size", F.least("most", F.col("weight") * F.coalesce(settled, F.col("most") / F.col("weight"))).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """(source, source_size, target, rounds, threshold): whole repeats of a source, and the hash below which one more is taken."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    bound = materialise(
        targets.withColumn("rounds", rounds)
        .withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("rounds") * F.col("source_size")))
        .withColumn("prefix", F.lit(0).cast("long")),
        "mix-bound",
    )
    shift = bits * levels
    for _ in range(levels):
        above, shift = shift, shift - bits
        edge = bound.select(F.col("source").alias("edge_source"), F.col("prefix").alias("edge"))
        inside = sizes.join(small(edge), sizes.source.eqNullSafe(F.col("edge_source")) & (F.shiftright("h", above) == F.col("edge")))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(running))
        left = bound.select(F.col("source").alias("budget_source"), "budget")
        over = sums.join(small(left), sums.source.eqNullSafe(F.col("budget_source"))).where(F.col("upto") > F.col("budget"))
        first = over.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("below")), "bucket").alias("hit"))
        first = first.select(F.col("source").alias("hit_source"), "hit")
        bound = materialise(
            bound.join(first, bound.source.eqNullSafe(F.col("hit_source")), "left")
            # no bucket passes the budget: a source of no words, of which nothing more is needed
            .withColumn("budget", F.when(F.col("hit").isNull(), F.lit(0.0)).otherwise(F.col("budget") - F.col("hit.below")))
            .withColumn("prefix", F.coalesce(F.col("hit.bucket"), F.shiftleft("prefix", bits)))
            .drop("hit", "hit_source"),
            "mix-bound",
        )
    return bound.select("source", "source_size", "target", "rounds", F.col("prefix").alias("threshold"))


def small(per_source: DataFrame) -> DataFrame:
    """Broadcast a per-source table after counting it; a larger one is left to a shuffled join, which splits hot sources."""
    return F.broadcast(per_source) if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else per_source


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, limit: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents with ``_mix_copies``, how often the mix takes each (0 included), beside their own columns.

    Null or empty texts have size 0, follow their hash like others and never use up a budget. Rows with the same id share
    one hash and are taken together. A null source is a source of its own. Empty input gives an empty result. Texts of any
    length are counted whole; only columns whose names begin with _mix_ clash.
    """
    sizes = materialise(sized(docs, id_col, text_col, source_col), "mix-sizes")
    bound = thresholds(sizes, source_targets(sizes, weights, share, limit))
    return with_copies(docs.withColumn("_mix_h", id_hash(id_col)).withColumn("_mix_source", F.col(source_col)), bound).drop("_mix_h", "_mix_source")


def with_copies(rows: DataFrame, bound: DataFrame) -> DataFrame:
    edge = bound.select(F.col("source").alias("_mix_key"), F.col("rounds").alias("_mix_rounds"), F.col("threshold").alias("_mix_edge"))
    joined = rows.join(small(edge), rows["_mix_source"].eqNullSafe(F.col("_mix_key")), "left")
    extra = (F.col("_mix_h") < F.col("_mix_edge")).cast("long")
    return joined.withColumn("_mix_copies", F.col("_mix_rounds") + extra).drop("_mix_key", "_mix_rounds", "_mix_edge")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, in its own columns."""
    taken = mix(docs, **options).where("_mix_copies > 0")
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so none, one or more rows in its own columns; cases as in ``mix``."""
    return mixed_documents(docs)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = materialise(sized(docs), "mix-sizes")
    bound = thresholds(sizes, source_targets(sizes))
    rows = with_copies(sizes.withColumn("_mix_h", F.col("h")).withColumn("_mix_source", F.col("source")), bound)
    per = bound.select(F.col("source").alias("per_source"), "source_size", "target")
    rows = rows.join(small(per), rows["_mix_source"].eqNullSafe(F.col("per_source")), "left")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_mix_copies")).alias("taken"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE AS all_words,
         coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_words,
         sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM per),
level AS (SELECT *, (all_words * 1.5::DOUBLE - full_words) / open_weight AS lvl FROM ranked),
target AS (
  SELECT source, source_size, least(most, weight * max(CASE WHEN lvl * weight <= most THEN lvl END) OVER ())::DOUBLE AS target
  FROM level),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS rounds FROM target),
running AS (
  SELECT s.*, b.source_size, b.target, b.rounds, greatest(0.0, b.target - b.rounds * b.source_size) AS left_over,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source),
edge AS (
  SELECT *, coalesce(min(CASE WHEN upto > left_over THEN h END) OVER (PARTITION BY source), 0) AS threshold FROM running)
SELECT doc_id, size, source_size, target, (size * (rounds + CASE WHEN h < threshold THEN 1 ELSE 0 END))::BIGINT AS taken
FROM edge
"""
