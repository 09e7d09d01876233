"""Deletion as new snapshots of the tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.search import BOTH
from corpusloom.sources.corpus import Corpus


def drop_texts(corpus: Corpus, gone: DataFrame) -> Corpus:
    """The corpus without the texts of ``gone(text_id)`` and all that hangs on them; cross rows go by text, token or sentence."""
    ids = gone.select("text_id").distinct()
    tokens = corpus.tokens.join(ids, "text_id", "left_semi").select("token_id")
    sentences = corpus.sentences.join(ids, "text_id", "left_semi").select("sentence_id")
    cross = corpus.cross.join(ids, "text_id", "left_anti").join(tokens, "token_id", "left_anti").join(sentences, "sentence_id", "left_anti")
    kept = {name: getattr(corpus, name).join(ids, "text_id", "left_anti") for name in ("texts", "sentences", "tokens", "words")}
    return Corpus(cross=cross.select(*corpus.cross.columns), **{n: df.select(*getattr(corpus, n).columns) for n, df in kept.items()})


def _lower_counts(tokens: DataFrame, removed: DataFrame) -> DataFrame:
    """token_count less the removed rows, not below 0; word frequencies stay as they are."""
    joined = tokens.join(removed, "token_id", "left")
    count = F.greatest(F.lit(0), F.col("token_count") - F.coalesce("_removed", F.lit(0)))
    return joined.withColumn("token_count", count).select(*tokens.columns)


def remove_occurrences(corpus: Corpus, entries: DataFrame) -> Corpus:
    """Without as many cross rows of each (token_id, sentence_id, word_id) as ``entries`` lists it, smallest cross_id first."""
    key = ["token_id", "sentence_id", "word_id"]
    asked = entries.groupBy(*key).agg(F.count("*").alias("_k"))
    touched = corpus.cross.join(asked, key)
    chosen = touched.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("cross_id"))).where("_n <= _k")
    return _without(corpus, chosen.select("cross_id", "token_id"))


def remove_cross(corpus: Corpus, token_id: int, cross_ids: DataFrame) -> Corpus:
    """Without the cross rows named in ``cross_ids(cross_id string)``, whatever token they have; what is no whole number is ignored."""
    ids = cross_ids.select(F.expr("try_cast(cross_id as bigint)").alias("cross_id")).where("cross_id is not null").distinct()
    chosen = corpus.cross.join(ids, "cross_id", "left_semi").select("cross_id", F.lit(token_id).cast("long").alias("token_id"))
    return _without(corpus, chosen)


def _without(corpus: Corpus, chosen: DataFrame) -> Corpus:
    removed = chosen.groupBy("token_id").agg(F.count("*").alias("_removed"))
    cross = corpus.cross.join(chosen.select("cross_id"), "cross_id", "left_anti").select(*corpus.cross.columns)
    return replace(corpus, cross=cross, tokens=_lower_counts(corpus.tokens, removed))


def explode_links(contexts: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Distinct (word_id, sentence_id) of ``contexts(word_id, sentence_ids "1, 4, 7")`` that ``links`` does not have yet."""
    rows = contexts.select("word_id", F.explode(F.split("sentence_ids", ", ")).alias("s"))
    rows = rows.select("word_id", F.expr("try_cast(s as bigint)").alias("sentence_id")).where("sentence_id is not null").distinct()
    return rows if links is None else rows.join(links, ["word_id", "sentence_id"], "left_anti")
