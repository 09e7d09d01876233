"""Sentence search and extraction: semi joins in place of id lists, context windows, concordances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import contains_literal, once
from corpusloom.operators import analyse
from corpusloom.operators.ingest import before_spans, span_of
from corpusloom.sources.shared import materialise

#: Fixed value: what a concordance shows where the sentence is missing.
MISSING = "Текст не найден"
BOTH = ["text_id", "token_id"]
#: Longest list of words that is broadcast.
BROADCAST_WORDS = 100_000
#: Words that sentences are searched for one after another, and characters of such a word.
CHAIN_WORDS, CHAIN_LENGTH = 256, 64


def positive_links(cross: DataFrame, tokens: DataFrame) -> DataFrame:
    """Cross rows of tokens that occur."""
    return cross.join(tokens.where("token_count > 0").select(*BOTH), BOTH, "left_semi")


def sentences_with_tokens(sentences: DataFrame, cross: DataFrame, tokens: DataFrame) -> DataFrame:
    """Sentences linked to a token that occurs, each once."""
    return sentences.join(positive_links(cross, tokens).select("sentence_id"), "sentence_id", "left_semi")


def sentences_with_author(sentences: DataFrame, cross: DataFrame, tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """Those with author and title: ``Unknown`` where the text row is missing, null where its author is null."""
    hits = sentences_with_tokens(sentences, cross, tokens)
    named = texts.select("text_id", "author", "title", F.lit(True).alias("_known"))
    joined = hits.join(named, "text_id", "left")
    unknown = F.col("_known").isNull()
    return joined.select("text_id", "sentence_id", *[F.when(unknown, "Unknown").otherwise(F.col(c)).alias(c) for c in ("author", "title")], "sentence")


def sentences_with_context(sentences: DataFrame, hits: DataFrame, before: int = 2, after: int = 2, scope: str = "text") -> DataFrame:
    """Hits with their neighbours, distinct by (text_id, sentence).

    ``text``: neighbours within the text. ``global``: by sentence id over the whole corpus, so context crosses text borders; positions
    come from sentence counts per text and a running sum over texts in range partitions, never from one sort in a single task.
    """
    base = sentences.select("text_id", "sentence_id", "sentence")
    marks = hits.select("sentence_id").distinct()
    per_text = Window.partitionBy("text_id").orderBy("sentence_id")
    if scope == "text":
        marked = base.join(marks.withColumn("_hit", F.lit(True)), "sentence_id", "left")
        near = F.max("_hit").over(per_text.rowsBetween(-after, before))
        return marked.withColumn("_near", near).where("_near").dropDuplicates(["text_id", "sentence"]).select("text_id", "sentence")
    placed = base.withColumn("_place", F.row_number().over(per_text).cast("long"))
    placed = placed.join(_text_offsets(base), "text_id").withColumn("_place", F.col("_place") + F.col("_before")).drop("_before")
    near = F.explode(F.sequence(F.col("_place") - before, F.col("_place") + after)).alias("_place")
    wanted = placed.join(marks, "sentence_id", "left_semi").select(near).distinct()
    return placed.join(wanted, "_place", "left_semi").dropDuplicates(["text_id", "sentence"]).select("text_id", "sentence")


def _text_offsets(sentences: DataFrame) -> DataFrame:
    """(text_id, number of sentences of all texts before it)."""
    counts = sentences.groupBy("text_id").agg(F.count("*").alias("_c")).withColumn("_s", span_of())
    spans = before_spans(counts.groupBy("_s").agg(F.sum("_c").alias("_n")))
    inside = Window.partitionBy("_s").orderBy("text_id").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(spans, "_s").select("text_id", (F.col("_before") + F.col("_in")).alias("_before"))


def flag_keywords(df: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Rows whose lower-cased sentence has a keyword as substring. The keywords are literals of the plan."""
    if not keywords:
        raise ValueError("no keywords")
    low = F.lower("sentence")
    hit = F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k.lower())
    return df.where(hit)


def keyword_sentences(sentences: DataFrame, cross: DataFrame, texts: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """(sentence, author, genre), one row per cross link of a sentence that has a keyword; filtered before it is joined."""
    if not keywords:
        raise ValueError("no keywords")
    hit = F.lit(False)
    for k in keywords:
        hit = hit | contains_literal(F.col("sentence"), F.col("_low"), k)
    found = once(sentences.select("sentence_id", "sentence"), F.lower("sentence").alias("_low")).where(hit).select("sentence_id", "sentence")
    links = cross.select("sentence_id", "text_id")
    return found.join(links, "sentence_id").join(texts.select("text_id", "author", "genre"), "text_id").select("sentence", "author", "genre")


def words_in_sentences(sentences: DataFrame, words: DataFrame, size: int = 3, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Distinct (sentence_id, word) where the sentence has the word, of ``words(word)``, as a substring, in small letters both; for lists of any length.

    Of each word the rarest stretch of ``size`` characters (all of a shorter word) decides which sentences are looked at; what shares it is
    compared as a whole. Stretches are counted by sentence before they are shuffled. A written list of no more than ``broadcast_words`` words, and characters
    in proportion, goes to every task, so sentences stay where they are; a longer one is joined with pairs of sentence and stretch, and sentences are fetched for what has met.
    """
    return _words_met(sentences, words, size, broadcast_words).select("sentence_id", "word").distinct()


def _words_met(sentences: DataFrame, words: DataFrame, size: int, broadcast_words: int) -> DataFrame:
    """Rows (sentence_id, word) as above, which repeat where sentence ids do."""
    low = words.select(F.lower("word").alias("word")).where("word <> ''").distinct().withColumn("_n", F.least(F.length("word"), F.lit(size)))
    grams = low.select("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - F.col("_n") + 1), lambda i: F.substr("word", i, F.col("_n"))))).alias("gram"))
    # at most `size` lengths
    sizes = sorted(r.n for r in low.select(F.col("_n").alias("n")).distinct().collect())
    small = once(sentences.select("sentence_id", "sentence"), F.lower("sentence").alias("_low")).select("sentence_id", "_low")
    stretches = lambda n: F.when(F.length("_low") >= n, F.transform(F.sequence(F.lit(1), F.length("_low") - n + 1), lambda i: F.substr("_low", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    listed = F.array_distinct(F.concat(*[stretches(n) for n in sizes])) if sizes else F.array().cast("array<string>")
    found = small.select("sentence_id", "_low", F.explode(listed).alias("gram"))
    often = found.groupBy("gram").agg(F.count("*").alias("_n"))
    # a word with a stretch that no sentence has is in none
    rarest = grams.join(often, "gram", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("g"))
    rarest = materialise(rarest.where("g.n > 0").select("word", "g.gram"), "rarest-stretches")
    held = rarest.agg(F.count("*").alias("words"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("characters")).first()
    if held.words <= broadcast_words and held.characters <= 16 * broadcast_words:
        met = found.join(F.broadcast(rarest), "gram")
    else:
        pairs = found.select(F.col("sentence_id").alias("_id"), "gram").join(rarest.hint("merge"), "gram").select("_id", "word")
        met = pairs.join(small.hint("merge"), F.col("_id").eqNullSafe(F.col("sentence_id")))
    return met.where(F.contains("_low", "word"))


def _has_any(low: Column, words: Sequence[str]) -> Column:
    return F.exists(F.lit(list(words)), lambda w: F.contains(low, w)) if words else F.lit(False)


def least_words(words: DataFrame, most: int = CHAIN_WORDS) -> tuple[list[str], DataFrame]:
    """(least words, the others): of ``words(word)`` in small letters, the first ``most`` or so that hold no other listed word, shortest first, and those that hold none of
    these. What holds any listed word holds one of the two, so where no others are left, a list of any length is as good as its least words."""
    least, left = [], materialise(words.select(F.lower("word").alias("word")).where("word <> ''").distinct(), "words")
    while len(least) < most:
        some = [r.word for r in left.where(F.length("word") <= CHAIN_LENGTH).orderBy(F.length("word"), "word").limit(most).collect()]
        if not some:
            break
        new = []
        for word in some:
            if not any(w in word for w in new):
                new.append(word)
        least, left = least + new, materialise(left.where(~_has_any(F.col("word"), new)), "words")
    return least, left


def flag_words(sentences: DataFrame, words: DataFrame, size: int = 3, broadcast_words: int = BROADCAST_WORDS, chain_words: int = CHAIN_WORDS) -> DataFrame:
    """As ``flag_keywords``, for a list of any length. Sentences are searched for its least words; only those that have none of them are met with the others, if there are any."""
    least, others = least_words(words, chain_words)
    low = once(sentences, F.lower("sentence").alias("_low"))
    hit = low.where(_has_any(F.col("_low"), least)).select(*sentences.columns)
    if others.isEmpty():
        return hit
    rest = low.where(~_has_any(F.col("_low"), least)).select(*sentences.columns)
    return hit.unionByName(_flagged(rest, others, size, broadcast_words))


def _flagged(sentences: DataFrame, words: DataFrame, size: int, broadcast_words: int) -> DataFrame:
    return sentences.join(_words_met(sentences, words, size, broadcast_words).select("sentence_id").distinct(), "sentence_id", "left_semi")


def concordance(
    cross: DataFrame, words: DataFrame, tokens: DataFrame, sentences: DataFrame, text_id: int | None, token: str, distinct: bool = True, tag: str = "mark", lexicon: DataFrame | None = None
) -> DataFrame:
    """Occurrences of a token (of one text, or of all for None): its lemma, from lexicon(form, lemma), is looked for, and what was typed is highlighted
    in the sentence wherever it stands just so. An unknown token gives no rows."""
    chosen = tokens.where(F.col("token") == lemma_of(tokens.sparkSession, token, lexicon))
    if text_id is not None:
        chosen = chosen.where(F.col("text_id") == text_id)
    rows = cross.join(chosen.select(*BOTH), BOTH, "left_semi").select("text_id", "sentence_id", "word_id", *([] if distinct else ["cross_id"]))
    if distinct:
        rows = rows.distinct()
    return _shown(rows.join(words.select("text_id", "word_id", "word", "pos"), ["text_id", "word_id"], "left"), sentences, token, tag)


def concordance_of_postings(postings: DataFrame, sentences: DataFrame, text_id: int | None, token: str, distinct: bool = True, tag: str = "mark", lexicon: DataFrame | None = None) -> DataFrame:
    """The same from stored postings: only row groups that have the token are read, and nothing but sentences is joined."""
    rows = postings.where(F.col("token") == lemma_of(postings.sparkSession, token, lexicon))
    rows = rows if text_id is None else rows.where(F.col("text_id") == text_id)
    rows = rows.select("text_id", "word_id", "sentence_id", *([] if distinct else ["cross_id"]), "word", "pos")
    return _shown(rows.distinct() if distinct else rows, sentences, token, tag)


def lemma_of(spark: SparkSession, typed: str, lexicon: DataFrame | None = None) -> str:
    """The lemma of one typed word."""
    word = spark.range(1).select(F.lit(0).alias("position"), F.lower(F.lit(typed)).alias("word"))
    return analyse.request_list(analyse.lemmatise(word, lexicon))[0].token


def _shown(rows: DataFrame, sentences: DataFrame, token: str, tag: str) -> DataFrame:
    full = rows.join(sentences.select("sentence_id", "sentence"), "sentence_id", "left")
    shown = F.replace("sentence", F.lit(token), F.lit(f"<{tag}>{token}</{tag}>"))
    return full.withColumn("shown", F.when(F.col("sentence").isNull(), MISSING).otherwise(shown)).drop("sentence")


def tokens_of_text(tokens: DataFrame, text_id: int) -> DataFrame:
    return tokens.where(F.col("text_id") == text_id).select("token", "token_count", "token_id")


def words_of_token(words: DataFrame, tokens: DataFrame, token: str) -> DataFrame:
    """Words of a token in every text that has it."""
    return words.join(tokens.where(F.col("token") == token).select(*BOTH), BOTH, "left_semi")


def sentences_of_word(cross: DataFrame, words: DataFrame, tokens: DataFrame, sentences: DataFrame, word: str) -> DataFrame:
    """Per text the sentences of the first row (by part of speech, then token) that has the word."""
    first = Window.partitionBy("text_id").orderBy("pos", "token")
    chosen = words.where(F.col("word") == word).join(tokens.select("token", *BOTH), BOTH).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("text_id", "word_id")
    ids = cross.join(chosen, ["text_id", "word_id"], "left_semi").select("sentence_id")
    return sentences.join(ids, "sentence_id", "left_semi")


def top_words_by_pos(words: DataFrame, pos: str = "ADJ", n: int = 10) -> DataFrame:
    """The n most frequent word rows of a part of speech; ties by word, then text."""
    return words.where(F.col("pos") == pos).orderBy(F.desc("frequency"), "word", "text_id", "token_id").limit(n)


def by_authors(df: DataFrame, authors: Sequence[str] | None = None) -> DataFrame:
    """Rows of the named authors; all rows where none is named."""
    return df.where(F.col("author").isin(*authors)) if authors else df
