"""Taking in texts: new titles only, valid years, sentences with fixed ids, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import sentence_array, strip, text_label

#: Distance of the sentence ids of two texts. An array of so many sentences wouldn't fit the 2 GB of a row, so no text runs out of ids.
ID_SPAN = 1 << 27
#: Text ids, or numbers, that have sentence ids are below this, and not below its negative.
IDS = 1 << 36
#: Bits of an id within its span, of a span within its span of spans, and of that within the next.
SPAN_BITS = (10, 17, 18)


def new_texts_only(incoming: DataFrame, texts: DataFrame) -> DataFrame:
    """Incoming rows whose title is neither stored nor taken by a row of smaller text_id in the same batch."""
    first = Window.partitionBy("title").orderBy("text_id")
    fresh = incoming.join(texts.select("title"), "title", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*incoming.columns)


def validate_year(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with trimmed fields and a whole year, rejected as they came)."""
    whole = F.expr("try_cast(_year as int)")
    checked = df.withColumn("_year", strip(F.col("year").cast("string")))
    trimmed = [whole.alias("year") if c == "year" else strip(F.col(c)).alias(c) if c in ("title", "author", "genre") else F.col(c) for c in df.columns]
    return checked.where(whole.isNotNull()).select(*trimmed), checked.where(whole.isNull()).select(*df.columns)


def ids_fit(texts: DataFrame) -> bool:
    """Whether sentence ids can be made from all text ids as they are; reads the ids alone."""
    wrong = F.col("text_id").isNull() | ~F.col("text_id").between(-IDS, IDS - 1)
    return texts.where(wrong).isEmpty()


def split_sentences(texts: DataFrame, *keep: str, numbered: bool = False) -> DataFrame:
    """Rows (text_id, pos, sentence_id, sentence) with the columns of the text to keep; the id is text_id * 2**27 + pos, so ids follow the
    order of texts and places. An id that doesn't fit (``ids_fit``) gives null sentence ids; with ``numbered`` the texts' numbers (``numbered_texts``) take
    the place of their ids there, at the cost of dealing the texts out, so any 64-bit id will do, and none, and ids that repeat."""
    if numbered:
        texts = numbered_texts(texts.select("text_id", *({"title"} & set(texts.columns)), *[k for k in keep if k != "title"], "text"))
    key = "number" if numbered else "text_id"
    found = texts.select("text_id", *keep, F.col(key).alias("_key"), F.posexplode(sentence_array(F.col("text"))).alias("pos", "sentence"))
    sentence_id = F.when(F.col("_key").between(-IDS, IDS - 1), F.col("_key") * ID_SPAN + F.col("pos"))
    return found.select("text_id", *keep, "pos", sentence_id.alias("sentence_id"), "sentence")


def list_texts(texts: DataFrame) -> DataFrame:
    """(number, text_id, title) of all texts."""
    return numbered_texts(texts.select("text_id", "title")).select("number", "text_id", "title")


def span_of(column: str = "text_id") -> Column:
    """The span of 2**10 ids that an id is in; rows without id have one of their own beyond all others."""
    return F.coalesce(F.shiftright(column, SPAN_BITS[0]), F.lit(1 << 63 - SPAN_BITS[0]))


def before_spans(counts: DataFrame) -> DataFrame:
    """(_s, _before) of counts(_s, _n), one row per span: the sum of _n over all smaller spans.

    Spans are gathered into spans of spans, and those again, so a running sum in one task has at most 2**19 rows wherever in the 64 bits the ids are.
    """
    before = lambda n, at, *of: F.coalesce(F.sum(n).over(Window.partitionBy(*of).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.select("_s", "_n", F.shiftright("_s", SPAN_BITS[1]).alias("_t"))
    wide = spans.groupBy("_t").agg(F.sum("_n").alias("_m")).withColumn("_u", F.shiftright("_t", SPAN_BITS[2]))
    widest = wide.groupBy("_u").agg(F.sum("_m").alias("_l"))
    starts = wide.select("_t", "_u", before("_m", "_t", "_u").alias("_in")).join(widest.select("_u", before("_l", "_u").alias("_start")), "_u")
    starts = starts.select("_t", (F.col("_in") + F.col("_start")).alias("_start"))
    return spans.withColumn("_in", before("_n", "_s", "_t")).join(starts, "_t").select("_s", (F.col("_in") + F.col("_start")).alias("_before"))


def numbered_texts(texts: DataFrame) -> DataFrame:
    """Texts numbered from 1 by id, equal ids by title, those without id last. A text's number is its place within its span of ids and the number of texts in spans before it: all
    by id alone, so no step depends on how Spark deals rows out."""
    base = texts.withColumn("_s", span_of())
    spans = before_spans(base.groupBy("_s").agg(F.count("*").alias("_n")))
    order = [c for c in ("text_id", "title") if c in texts.columns]
    within = F.row_number().over(Window.partitionBy("_s").orderBy(*order))
    return base.withColumn("_i", within).join(spans, "_s").select((F.col("_i") + F.col("_before")).alias("number"), *texts.columns)


def labelled(texts: DataFrame, with_year: bool = False) -> DataFrame:
    year = F.col("year") if with_year else None
    return texts.select("text_id", text_label(F.col("title"), F.col("author"), year).alias("label"))
