"""Postings of a stored corpus: which word stands with which token in which sentence, laid out for look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.corpus import Corpus

SCHEMA = "token string, text_id long, word string, pos string, sentence_id long, word_id long, cross_id long, token_id long"
#: Bytes of a row group: what a look-up of a rare token reads at least.
ROW_GROUP = 8 << 20


def write_postings(corpus: Corpus, path: str, row_group: int = ROW_GROUP) -> None:
    """The links of a corpus with their tokens and words, in ranges of (token, text) over the files and sorted within them. Statistics of row groups
    and pages leave out what lies beside a token or text, Bloom filters what has not its word. A token that fills many files has each of them to itself."""
    words = corpus.words.select("text_id", "word_id", "word", "pos")
    full = corpus.cross.join(corpus.tokens.select("text_id", "token_id", "token"), ["text_id", "token_id"], "left").join(words, ["text_id", "word_id"], "left")
    full = full.select(*[c.split()[0] for c in SCHEMA.split(", ")])
    laid = full.repartitionByRange("token", "text_id", "word").sortWithinPartitions("token", "text_id", "word")
    writer = laid.write.option("parquet.block.size", str(row_group))
    for name in ("token", "word"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
