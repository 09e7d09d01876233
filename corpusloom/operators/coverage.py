"""Coverage and averages per text, each side aggregated before it is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import ratio
from corpusloom.operators.search import BOTH, positive_links


def _per_text(df: DataFrame, name: str, what) -> DataFrame:
    return df.groupBy("text_id").agg(what.alias(name))


def text_coverage(texts: DataFrame, sentences: DataFrame, cross: DataFrame, tokens: DataFrame) -> DataFrame:
    """Sentences, sentences linked to a token that occurs, and percent, for every text; null percent without sentences."""
    total = _per_text(sentences.select("text_id", "sentence_id").distinct(), "total_sentences", F.count("*"))
    own = sentences.select("text_id", "sentence_id")
    linked = positive_links(cross, tokens).select("text_id", "sentence_id").distinct().join(own, ["text_id", "sentence_id"], "left_semi")
    linked = _per_text(linked, "token_sentences", F.count("*"))
    out = texts.join(total, "text_id", "left").join(linked, "text_id", "left").fillna(0, ["total_sentences", "token_sentences"])
    return out.select("text_id", "title", "author", "year", "total_sentences", "token_sentences", ratio(F.col("token_sentences") * 100, F.col("total_sentences")).alias("token_sentence_percent"))


def text_coverage_joined(sentences: DataFrame, cross: DataFrame, tokens: DataFrame) -> DataFrame:
    """Counts as a join on the text alone gives them: S * max(C, 1) * K in all, distinct linked sentences; texts with no non-zero token go."""
    s = _per_text(sentences, "s", F.count("*"))
    c = cross.groupBy("text_id").agg(F.count("*").alias("c"), F.countDistinct("sentence_id").alias("d"))
    k = _per_text(tokens.where("token_count <> 0"), "k", F.count("*"))
    joined = s.join(k, "text_id").join(c, "text_id", "left").fillna(0, ["c", "d"])
    return joined.select("text_id", (F.col("s") * F.greatest("c", F.lit(1)) * F.col("k")).alias("total_sentences"), F.col("d").alias("token_sentences"))


def title_coverage(texts: DataFrame, sentences: DataFrame, cross: DataFrame) -> DataFrame:
    """Per title S * max(C, 1) rows, S * C linked ones and their percent, without building them; texts without sentences go."""
    s, c = _per_text(sentences, "s", F.count("*")), _per_text(cross, "c", F.count("*"))
    joined = texts.join(s, "text_id").join(c, "text_id", "left").fillna(0, ["c"])
    summed = joined.groupBy("title").agg(F.sum(F.col("s") * F.greatest("c", F.lit(1))).alias("total_sentences"), F.sum(F.col("s") * F.col("c")).alias("token_sentences"))
    return summed.select("*", ratio(F.col("token_sentences") * 100, F.col("total_sentences")).alias("percent"))


def avg_words_per_sentence(cross: DataFrame) -> DataFrame:
    """Mean number of distinct words of the linked sentences of a text."""
    each = cross.groupBy("text_id", "sentence_id").agg(F.countDistinct("word_id").alias("n"))
    return each.groupBy("text_id").agg(F.avg("n").alias("avg_words"))


def _links_per_sentence(cross: DataFrame, tokens: DataFrame) -> DataFrame:
    """(text_id, sentence_id, n = all links, p = links of tokens that occur); one pass serves both averages."""
    occurs = tokens.select(*BOTH, (F.col("token_count") > 0).cast("long").alias("_p"))
    marked = cross.select("sentence_id", *BOTH).join(occurs, BOTH, "left")
    return marked.groupBy("text_id", "sentence_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("_p", F.lit(0))).alias("p"))


def link_averages(cross: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per text: mean links of a token sentence, and the mean weighted by its links of tokens that occur; two digits."""
    each = _links_per_sentence(cross, tokens).where("p > 0")
    summed = each.groupBy("text_id").agg(F.sum("n").alias("n"), F.count("*").alias("m"), F.sum(F.col("p") * F.col("n")).alias("pn"), F.sum("p").alias("p"))
    return summed.select("text_id", ratio(F.col("n"), F.col("m")).alias("avg_links"), ratio(F.col("pn"), F.col("p")).alias("avg_links_weighted"))


def coverage_vs_length(texts: DataFrame, sentences: DataFrame, cross: DataFrame, tokens: DataFrame) -> DataFrame:
    """Coverage beside mean links, most token sentences first."""
    out = text_coverage(texts, sentences, cross, tokens).join(link_averages(cross, tokens).select("text_id", "avg_links"), "text_id", "left")
    return out.select("text_id", "title", "total_sentences", "token_sentences", "token_sentence_percent", "avg_links").orderBy(F.desc("token_sentences"), "text_id")
