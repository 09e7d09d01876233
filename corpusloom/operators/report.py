"""The nested report per text, and what is read from it over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import ratio
from corpusloom.operators.search import BOTH


def tokens_json(tokens: DataFrame) -> DataFrame:
    """Per text its tokens of positive count as an array of (token, count), largest first, then by token."""
    pairs = tokens.where("token_count > 0").groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("token_count")).alias("k"), "token"))).alias("p"))
    return pairs.select("text_id", F.transform("p", lambda x: F.struct(x["token"].alias("token"), (-x["k"]).alias("count"))).alias("top_tokens"))


def pos_per_token(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Per (text, token) its parts of speech with number of word rows and sorted distinct words, most first; null without words."""
    known = words.where("pos is not null").groupBy(*BOTH, "pos").agg(F.countDistinct("word_id").alias("n"), F.sort_array(F.collect_set("word")).alias("examples"))
    order = F.struct((-F.col("n")).alias("k"), F.col("pos").alias("part_of_speech"), F.col("n").alias("frequency"), "examples")
    lists = known.groupBy(*BOTH).agg(F.sort_array(F.collect_list(order)).alias("p"))
    lists = lists.select(*BOTH, F.transform("p", lambda x: x.dropFields("k")).alias("pos_list"))
    return tokens.select("token", *BOTH).join(lists, BOTH, "left").select("text_id", "token", "pos_list")


def pos_map(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Per text a map from ``top_pos_<token>`` to the list of that token."""
    rows = pos_per_token(tokens, words).where("token is not null")
    return rows.groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("top_pos_"), "token"), "pos_list"))).alias("top_pos_stats"))


def text_report(texts: DataFrame, sentences: DataFrame, cross: DataFrame, tokens: DataFrame, words: DataFrame) -> DataFrame:
    """All measures per text: coverage, averages, tokens and parts of speech.

    Links meet their tokens once. Their counts per sentence are added up together with the sentences, which gives totals, linked sentences and both
    averages; words and tokens are gathered per token and then per text, which gives both lists.
    """
    occurs = tokens.select(*BOTH, (F.col("token_count") > 0).cast("long").alias("p"))
    links = cross.select("sentence_id", *BOTH).join(occurs, BOTH, "left")
    none = F.lit(0).cast("long")
    rows = links.select("text_id", "sentence_id", none.alias("own"), F.lit(1).cast("long").alias("n"), F.coalesce("p", none).alias("p"))
    rows = rows.unionByName(sentences.select("text_id", "sentence_id", F.lit(1).cast("long").alias("own"), none.alias("n"), none.alias("p")))
    each = rows.groupBy("text_id", "sentence_id").agg(F.max("own").alias("own"), F.sum("n").alias("n"), F.sum("p").alias("p"))
    hit = F.col("p") > 0
    measures = each.groupBy("text_id").agg(
        F.sum("own").alias("total_sentences"), F.sum(F.when(hit, F.col("own"))).alias("token_sentences"), F.sum(F.when(hit, F.col("n"))).alias("_n"), F.count(F.when(hit, 1)).alias("_m"),
        F.sum(F.col("p") * F.col("n")).alias("_pn"), F.sum("p").alias("_p"),
    )

    word = F.struct("pos", "word", "word_id")
    rows = words.where("pos is not null").select(*BOTH, F.lit(None).cast("string").alias("token"), F.lit(None).cast("long").alias("count"), word.alias("w"))
    rows = rows.unionByName(tokens.select(*BOTH, "token", F.col("token_count").alias("count"), F.lit(None).cast(rows.schema["w"].dataType).alias("w")))
    per_token = rows.groupBy(*BOTH).agg(F.max("token").alias("token"), F.max("count").alias("count"), F.collect_list("w").alias("w")).where("token is not null")

    def of_pos(w, pos):
        own = F.filter(w, lambda x: x["pos"] == pos)
        n = F.size(F.array_distinct(F.transform(own, lambda x: x["word_id"]))).cast("long")
        return F.struct((-n).alias("k"), pos.alias("part_of_speech"), n.alias("frequency"), F.array_sort(F.array_distinct(F.transform(own, lambda x: x["word"]))).alias("examples"))

    lists = F.array_sort(F.transform(F.array_distinct(F.transform("w", lambda x: x["pos"])), lambda pos: of_pos(F.col("w"), pos)))
    entry = F.struct(F.concat(F.lit("top_pos_"), "token").alias("key"), F.when(F.size("w") > 0, F.transform(lists, lambda x: x.dropFields("k"))).alias("value"))
    listed = per_token.select("text_id", F.when(F.col("count") > 0, F.struct((-F.col("count")).alias("k"), "token")).alias("t"), entry.alias("e"))
    listed = listed.groupBy("text_id").agg(F.sort_array(F.collect_list("t")).alias("t"), F.map_from_entries(F.collect_list("e")).alias("top_pos_stats"))
    top = F.when(F.size("t") > 0, F.transform("t", lambda x: F.struct(x["token"].alias("token"), (-x["k"]).alias("count"))))
    listed = listed.select("text_id", top.alias("top_tokens"), "top_pos_stats")

    out = texts.join(measures, "text_id", "left").join(listed, "text_id", "left").fillna(0, ["total_sentences", "token_sentences"])
    return out.select(
        "text_id", "title", "author", "year", "total_sentences", "token_sentences", ratio(F.col("token_sentences") * 100, F.col("total_sentences")).alias("token_sentence_percent"),
        "top_tokens", F.when(F.col("_m") > 0, ratio(F.col("_n"), F.col("_m"))).alias("avg_links"), F.when(F.col("_m") > 0, ratio(F.col("_pn"), F.col("_p"))).alias("avg_links_weighted"), "top_pos_stats",
    ).orderBy("text_id")


def corpus_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.sum("total_sentences").alias("total_sentences"), F.sum("token_sentences").alias("token_sentences"),
        F.avg("token_sentence_percent").alias("avg_percent"), F.avg("avg_links").alias("avg_links"),
    )


def top_tokens_corpus(report: DataFrame, n: int = 10) -> DataFrame:
    rows = report.select(F.explode("top_tokens").alias("t")).select("t.token", "t.count")
    return rows.groupBy("token").agg(F.sum("count").alias("total")).orderBy(F.desc("total"), "token").limit(n)


def pos_distribution(report: DataFrame) -> DataFrame:
    lists = report.select(F.explode(F.map_values("top_pos_stats")).alias("l")).select(F.explode("l").alias("p"))
    return lists.groupBy(F.col("p.part_of_speech").alias("pos")).agg(F.sum("p.frequency").alias("total"))


def author_timeline(texts: DataFrame) -> DataFrame:
    return texts.select("year", "author", "title")


def token_graph(texts: DataFrame, tokens: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): text nodes, token nodes shared by texts and labelled by the last text that has them, edges ``contains``."""
    lists = tokens_json(tokens).select("text_id", F.explode(F.slice("top_tokens", 1, n)).alias("t"))
    rows = lists.select("text_id", "t.token", F.col("t.count").alias("n"))
    text_nodes = texts.select(F.concat(F.lit("text_"), F.col("text_id").cast("string")).alias("id"), F.concat("title", F.lit(" ("), F.coalesce("author", F.lit("")), F.lit(")")).alias("label"), F.lit("text").alias("type"))
    last = rows.groupBy("token").agg(F.max_by("n", "text_id").alias("n"))
    token_nodes = last.select("token", F.concat("token", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("label"), F.lit("token").alias("type")).withColumnRenamed("token", "id")
    edges = rows.select(F.concat(F.lit("text_"), F.col("text_id").cast("string")).alias("src"), F.col("token").alias("dst"), F.lit("contains").alias("label")).distinct()
    return text_nodes.unionByName(token_nodes), edges
