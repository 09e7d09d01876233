"""Totals, top-n lists, pivots and the wide table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.coverage import avg_words_per_sentence, text_coverage_joined


def _top(df: DataFrame, by: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows of each group; Spark prunes ``row_number() <= n`` before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def token_totals(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("text_id", "token").agg(F.sum("token_count").alias("total"))


def top_tokens(tokens: DataFrame, n: int = 5) -> DataFrame:
    return _top(token_totals(tokens), ["text_id"], [F.desc_nulls_last("total"), "token"], n)


def pos_totals(words: DataFrame, cross: DataFrame) -> DataFrame:
    """Sum of word frequencies per part of speech, each counted once per cross row: links are counted before the join."""
    links = cross.groupBy("text_id", "word_id").agg(F.count("*").alias("_n"))
    joined = words.join(links, ["text_id", "word_id"])
    return joined.groupBy("text_id", "pos").agg(F.sum(F.col("frequency") * F.col("_n")).alias("total"))


def top_pos(words: DataFrame, cross: DataFrame, n: int = 5) -> DataFrame:
    return _top(pos_totals(words, cross), ["text_id"], [F.desc_nulls_last("total"), "pos"], n)


def pivot_ranks(ranked: DataFrame, columns: dict[str, str], n: int = 5) -> DataFrame:
    """Ranks 1 to n as columns; ``columns`` maps a value column to a name with ``{i}`` in it. No scan for the distinct ranks."""
    cells = [F.max(F.when(F.col("rank") == i, F.col(c))).alias(name.format(i=i)) for c, name in columns.items() for i in range(1, n + 1)]
    return ranked.groupBy("text_id").agg(*cells)


def analytical_table(sentences: DataFrame, cross: DataFrame, tokens: DataFrame, words: DataFrame, n: int = 5) -> DataFrame:
    """Joined coverage and average words of a text, with its top tokens and parts of speech side by side."""
    base = text_coverage_joined(sentences, cross, tokens).join(avg_words_per_sentence(cross), "text_id")
    by_token = pivot_ranks(top_tokens(tokens, n), {"token": "Top{i}_Token", "total": "Top{i}_Count"}, n)
    by_pos = pivot_ranks(top_pos(words, cross, n), {"pos": "POS{i}", "total": "POS{i}_Count"}, n)
    return base.join(by_token, "text_id", "left").join(by_pos, "text_id", "left")


def compare_texts(words: DataFrame, tokens: DataFrame, text_a: int, text_b: int, n: int = 5) -> DataFrame:
    """Per part of speech the top words of two texts as ``word (frequency), ...`` strings, over the words of ``tokens``."""
    two = words.where(F.col("text_id").isin(text_a, text_b)).join(tokens.select("text_id", "token_id"), ["text_id", "token_id"], "left_semi")
    best = _top(two, ["pos", "text_id"], [F.desc_nulls_last("frequency"), "word", "token_id"], n)

    def listed(text: int):
        rows = F.array_sort(F.collect_list(F.when(F.col("text_id") == text, F.struct("rank", "word", "frequency"))))
        return F.array_join(F.transform(rows, lambda r: F.concat(r["word"], F.lit(" ("), r["frequency"].cast("string"), F.lit(")"))), ", ")

    return best.groupBy("pos").agg(listed(text_a).alias("words_a"), listed(text_b).alias("words_b"))


def top_words_with_context(words: DataFrame, cross: DataFrame, sentences: DataFrame, tokens: DataFrame, n: int = 5) -> DataFrame:
    """Per part of speech the top n of word, sentence rows; a word of many links can fill the list.

    Ranked on the links before sentences are fetched. A part of speech is a huge group, so each text is cut to n first.
    """
    own = words.join(tokens.select("text_id", "token_id"), ["text_id", "token_id"], "left_semi")
    rows = own.join(cross.select("text_id", "word_id", "sentence_id", "cross_id"), ["text_id", "word_id"]).join(sentences.select("sentence_id"), "sentence_id", "left_semi")
    order = [F.desc_nulls_last("frequency"), "word", "text_id", "sentence_id", "cross_id"]
    best = _top(_top(rows, ["pos", "text_id"], order, n), ["pos"], order, n)
    return best.join(sentences.select("sentence_id", "sentence"), "sentence_id").select("pos", "rank", "word", "frequency", "text_id", "sentence_id", "sentence")
