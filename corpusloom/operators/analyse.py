"""Target-word analysis: from a word list and sentences to tokens, collocates and their occurrences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions.text import WORD, contains_literal, contains_word, once, strip, strip_punct, token_array

#: Words of a request.
MOST_WORDS = 1_000
ANNOTATION = "array<struct<i:int,text:string,lemma:string,pos:string,head:int>>"


def parse_search_words(spark: SparkSession, request: str) -> DataFrame:
    """Rows (position, word) of a comma-separated list, lower-cased and stripped; a list without words is an error."""
    if not any(w.strip() for w in request.split(",")):
        raise ValueError("no search words")
    words = spark.range(1).select(F.posexplode(F.split(F.lower(F.lit(request)), ",")).alias("position", "word"))
    return words.select("position", strip(F.col("word")).alias("word")).where("word <> ''")


def lemmatise(words: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Adds ``token``, the lemma from lexicon(form, lemma), or the lower-cased word where it has none."""
    if lexicon is None:
        return words.withColumn("token", F.lower("word"))
    # The request is a user's list, so it becomes a filter of the lexicon.
    asked = [r.word for r in _bounded(words.select("word").distinct())]
    forms = lexicon.select(F.lower("form").alias("word"), "lemma").where(F.col("word").isin(asked)).groupBy("word").agg(F.min("lemma").alias("lemma"))
    return words.join(forms, "word", "left").select("position", "word", F.coalesce("lemma", F.lower("word")).alias("token"))


def _bounded(words: DataFrame) -> list[Row]:
    """The rows of a request, which a user typed; more than MOST_WORDS are an error."""
    rows = words.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a request has at most {MOST_WORDS} words")
    return rows


def request_list(words: DataFrame) -> list[Row]:
    return _bounded(words.select("position", "word", "token").orderBy("position"))


def request_pairs(texts: DataFrame, words: DataFrame) -> DataFrame:
    """All (text_id, position, word, token) of a request: its words are a literal beside each text, so nothing is joined."""
    each = [F.struct(F.lit(r.position).alias("position"), F.lit(r.word).alias("word"), F.lit(r.token).alias("token")) for r in request_list(words)]
    return texts.select("text_id", F.inline(F.array(*each)))


def new_pairs_only(pairs: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Pairs whose (text, lemma) is not stored; of words with one lemma the first by position stays, with its surface form."""
    if tokens is not None:
        pairs = pairs.join(tokens.select("text_id", "token"), ["text_id", "token"], "left_anti")
    first = Window.partitionBy("text_id", "token").orderBy("position")
    return pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def candidate_sentences(sentences: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per sentence that contains a requested surface form, with ``targets``, the lemmas it was asked for.

    The pairs of a text become one short array first, so a sentence meets one row and is annotated once however many words it has.
    """
    asked = pairs.groupBy("text_id").agg(F.collect_list(F.struct("word", "token")).alias("asked"))
    met = sentences.join(asked, "text_id")
    hits = F.filter("asked", lambda a: contains_word(F.col("sentence"), a["word"]))
    return met.withColumn("targets", F.transform(hits, lambda a: a["token"])).drop("asked").where("size(targets) > 0")


def candidates_of_request(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """The same where nothing is stored yet and every text is asked for all words: the request is part of the plan, so nothing is joined."""
    first: dict[str, Row] = {}
    for r in request_list(words):
        first.setdefault(r.token, r)
    low = once(sentences, F.lower("sentence").alias("_low"))
    hits = [F.when(contains_literal(F.col("sentence"), F.col("_low"), r.word), F.lit(r.token)) for r in first.values()]
    return once(low, F.array_compact(F.array(*hits)).alias("targets")).where("size(targets) > 0").drop("_low")


def rule_annotation(sentence: Column) -> Column:
    """A stand-in annotator for tests: lemma is the lower-cased token, the part of speech follows spelling, the head is the token before."""
    def pos(t: Column) -> Column:
        last = F.substring(t, -1, 1)
        return (
            F.when(~t.rlike(WORD), "PUNCT").when(F.length(t) <= 3, "PART").when(last.isin("e", "n"), "VERB").when(last == "s", "ADJ").otherwise("NOUN")
        )

    def one(t: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), t.alias("text"), F.lower(t).alias("lemma"), pos(t).alias("pos"), F.greatest(i - 1, F.lit(0)).alias("head"))

    return F.transform(token_array(sentence), one)


def with_annotations(sentences: DataFrame, annotations: DataFrame) -> DataFrame:
    """Stored annotations(sentence_id, tokens) joined to the candidates."""
    return sentences.join(annotations.select("sentence_id", "tokens"), "sentence_id")


def annotate(sentences: DataFrame, fn: Callable[[Iterator], Iterator]) -> DataFrame:
    """Hook for a linguistic model: ``fn`` gets pandas batches of ``sentences`` and yields them with a ``tokens`` column."""
    schema = StructType([*sentences.schema.fields, *StructType.fromDDL(f"tokens {ANNOTATION}").fields])
    return sentences.mapInPandas(fn, schema)


def occurrences(annotated: DataFrame) -> DataFrame:
    """(text_id, sentence_id, token, n, found): per sentence and target the number of lemma matches and its collocates in order.

    A collocate is the governing verb (``VERB_HEAD``, kept even if nothing is left of it) or a dependent that is not empty without
    punctuation. All inside the row: a sentence is one array, no self join.
    """
    def around(m: Column) -> Column:
        head = F.get("tokens", m["head"])
        verb = F.filter(F.array(F.struct(F.lit("VERB_HEAD").alias("pos"), strip_punct(head["lemma"]).alias("word"))), lambda _: (head["pos"] == "VERB") & (m["head"] != m["i"]))
        below = F.filter("tokens", lambda c: (c["head"] == m["i"]) & (c["i"] != m["i"]))
        named = F.transform(below, lambda c: F.struct(c["pos"].alias("pos"), strip_punct(c["lemma"]).alias("word")))
        return F.concat(verb, F.filter(named, lambda x: x["word"] != ""))

    per_target = annotated.select("text_id", "sentence_id", "tokens", F.explode("targets").alias("token"))
    matched = once(per_target, F.filter("tokens", lambda t: t["lemma"] == F.col("token")).alias("matches"))
    return matched.select("text_id", "sentence_id", "token", F.size("matches").cast("long").alias("n"), F.flatten(F.transform("matches", around)).alias("found"))


def token_key() -> Column:
    return F.xxhash64("text_id", "token")


def token_counts(occurrences_: DataFrame, pairs: DataFrame) -> DataFrame:
    """The tokens table: matches summed per (text, lemma); a pair without any keeps a row of count 0."""
    summed = occurrences_.groupBy("text_id", "token").agg(F.sum("n").alias("n"))
    out = pairs.select("text_id", "token").join(summed, ["text_id", "token"], "left")
    return out.select(token_key().alias("token_id"), "token", "text_id", F.coalesce("n", F.lit(0)).cast("long").alias("token_count"))


def collocates(occurrences_: DataFrame) -> DataFrame:
    """One row per collocate occurrence, with the ids that words and cross share. Ids are hashes of the business key; a token
    belongs to one text, and joins carry text_id too, so two keys meet only if they collide within one text."""
    rows = occurrences_.select("text_id", "sentence_id", "token", F.posexplode("found").alias("nth", "c"))
    return rows.select(
        "text_id", "sentence_id", "token", "nth", "c.pos", "c.word", token_key().alias("token_id"), F.xxhash64("text_id", "token", "c.pos", "c.word").alias("word_id")
    )


def build_words(collocates_: DataFrame) -> DataFrame:
    """The words table: one row per (text, token, pos, word) with its number of occurrences."""
    grouped = collocates_.groupBy("text_id", "token_id", "pos", "word", "word_id").agg(F.count("*").alias("frequency"))
    return grouped.select("word_id", "token_id", "word", "pos", "frequency", "text_id")


def build_cross(collocates_: DataFrame) -> DataFrame:
    """The cross table: one row per occurrence; the word id is known from the key, so nothing is joined."""
    return collocates_.select(F.xxhash64("sentence_id", "token", "nth").alias("cross_id"), "word_id", "sentence_id", "text_id", "token_id")


def analysis_report(pairs: DataFrame, stored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Status of each requested (text, lemma): exists, not found (no sentence has the surface form) or done."""
    seen = stored.select("text_id", "token", F.lit(True).alias("_stored")).distinct()
    met = candidates.select("text_id", F.explode("targets").alias("token")).distinct().withColumn("_met", F.lit(True))
    joined = pairs.select("text_id", "token").distinct().join(seen, ["text_id", "token"], "left").join(met, ["text_id", "token"], "left")
    status = F.when(F.col("_stored"), "exists").when(F.col("_met"), "done").otherwise("not found")
    return joined.select("text_id", "token", status.alias("status"))
