"""Style features of a sentence as built-in expressions: no Python in the row path."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_text, once, token_array
from corpusloom.sources.shared import materialise

#: Markers of a comparison, vowels, and the sample weights of the emotional score.
MARKERS = ("как", "словно", "подобно")
VOWELS = "аеёиоуыэюя"
EMOTIONS = {"сладкий": 1, "горький": -1, "приторный": -1}
#: Longest lexicon that is broadcast, in words and in characters.
BROADCAST_LEXICON, BROADCAST_CHARACTERS = 500_000, 8_000_000


def most_frequent(signs: Column) -> Column:
    """Highest count of one character in a string, 0 for an empty one."""
    each = F.array_distinct(F.split(signs, ""))
    counts = F.transform(each, lambda v: F.length(signs) - F.length(F.replace(signs, v, F.lit(""))))
    return F.when(signs == "", 0).otherwise(F.array_max(counts))


def lexical_diversity(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(0.0)


def pos_frequency(pos: Column) -> Column:
    """Count of each part of speech of a sentence."""
    return F.map_from_entries(F.transform(F.array_distinct(pos), lambda p: F.struct(p, F.size(F.filter(pos, lambda x: x == p)))))


def emotional_score(tokens: Column, weights: Mapping[str, int]) -> Column:
    """Sum of the weights of the lower-cased tokens; the lexicon is a literal, so meant for hundreds of entries."""
    if not weights:
        return F.lit(0)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    scores = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, F.lower(t)), F.lit(0)))
    return F.aggregate(scores, F.lit(0), lambda a, x: a + x)


def emotional_scores(df: DataFrame, lexicon: DataFrame, id_col: str = "sentence_id", tokens_col: str = "tokens", broadcast_words: int = BROADCAST_LEXICON) -> DataFrame:
    """``df`` with ``emotional_score`` from lexicon(word, weight) of any length. A written lexicon of no more than ``broadcast_words`` words, and characters in
    proportion, goes to every task, so no word is shuffled, but one sum for each sentence that has a listed word; for a longer one equal words of a sentence are
    counted before they are joined. A word that the lexicon has twice weighs the least of its weights. Rows need distinct ids; null ids and rows without a listed
    word score 0."""
    listed = materialise(lexicon.where("word is not null").groupBy("word").agg(F.min("weight").cast("long").alias("_weight")), "lexicon")
    held = listed.agg(F.count("*").alias("words"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("characters")).first()
    words = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.explode(F.transform(tokens_col, F.lower)).alias("word"))
    if held.words <= broadcast_words and held.characters <= broadcast_words * BROADCAST_CHARACTERS // BROADCAST_LEXICON:
        sums = words.join(F.broadcast(listed), "word").groupBy("_id").agg(F.sum("_weight").alias("_sum"))
    else:
        counted = words.groupBy("_id", "word").agg(F.count("*").alias("_n"))
        sums = counted.join(listed, "word").groupBy("_id").agg(F.sum(F.col("_n") * F.col("_weight")).alias("_sum"))
    joined = df.join(sums, F.col(id_col) == F.col("_id"), "left")
    return joined.select(*df.columns, F.coalesce("_sum", F.lit(0)).cast("long").alias("emotional_score"))


def contains_marker(sentence: Column, markers=MARKERS) -> Column:
    edge = r"[^\p{L}\p{N}_]"
    return sentence.rlike(rf"(?iu)(^|{edge})({'|'.join(markers)})($|{edge})")


def alliteration(sentence: Column) -> Column:
    """Highest count of one first letter over the words of the lower-cased sentence."""
    return most_frequent(first_letters(sentence))


def first_letters(sentence: Column) -> Column:
    """The first letters of the words of the lower-cased sentence, one after another."""
    return F.array_join(F.regexp_extract_all(F.lower(sentence), F.lit(r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]"), F.lit(0)), "")


def rhythm(sentence: Column, vowels: str = VOWELS) -> Column:
    return F.length(F.regexp_replace(F.lower(sentence), f"[^{vowels}]", ""))


def prepare(df: DataFrame, limit: int = 500) -> DataFrame:
    """Clean the sentence, drop empty ones, cut to ``limit`` characters, in that order."""
    cleaned = once(df.withColumnRenamed("sentence", "_raw"), F.substring(clean_text(F.col("_raw")), 1, limit).alias("sentence"))
    return cleaned.where("sentence <> ''").select(*df.columns)


def sentence_features(df: DataFrame, vowels: str = VOWELS, weights: Mapping[str, int] = EMOTIONS, markers=MARKERS, limit: int = 500) -> DataFrame:
    """All features that need no annotation, added to the rows of ``df``; empty sentences go."""
    df = once(prepare(df, limit), token_array(F.col("sentence")).alias("tokens"), first_letters(F.col("sentence")).alias("_first"))
    rows = df.select(
        "*",
        lexical_diversity(F.col("tokens")).alias("lexical_diversity"),
        F.size("tokens").alias("sentence_length"),
        emotional_score(F.col("tokens"), weights).alias("emotional_score"),
        contains_marker(F.col("sentence"), markers).alias("contains_metaphor"),
        most_frequent(F.col("_first")).alias("alliteration_score"),
        rhythm(F.col("sentence"), vowels).alias("rhythm_score"),
    )
    return rows.drop("_first")


def flatten_lists(df: DataFrame) -> DataFrame:
    """Array columns joined by a comma and a blank, map columns as JSON."""
    kinds = {name: kind for name, kind in df.dtypes}
    out = []
    for name, kind in kinds.items():
        col = F.col(name)
        if kind == "array<string>":
            col = F.array_join(col, ", ").alias(name)
        elif kind.startswith(("map<", "array<")):
            col = F.to_json(col).alias(name)
        out.append(col)
    return df.select(*out)


def author_stats(features: DataFrame) -> DataFrame:
    """Means, score sum and marker count per author; rows without an author go. Partial sums leave one row an author and task to shuffle."""
    return features.where("author is not null").groupBy("author").agg(
        F.avg("lexical_diversity").alias("lexical_diversity"),
        F.avg("sentence_length").alias("sentence_length"),
        F.sum(F.col("emotional_score").cast("long")).alias("emotional_score"),
        F.sum(F.col("contains_metaphor").cast("long")).alias("metaphors"),
        F.avg("alliteration_score").alias("alliteration_score"),
        F.avg("rhythm_score").alias("rhythm_score"),
    )


def author_list(features: DataFrame) -> DataFrame:
    """The authors that there are rows of, each once."""
    return features.where("author is not null").select("author").distinct()


def author_overview(features: DataFrame) -> DataFrame:
    """Mean lexical diversity and row count per author."""
    return features.groupBy("author").agg(F.avg("lexical_diversity").alias("lexical_diversity"), F.count("*").alias("n_sentences"))
