"""The analysis job: documents and a word list to the five corpus tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import once
from corpusloom.operators import analyse, ingest
from corpusloom.sources import store
from corpusloom.sources.corpus import Corpus, read_corpus, spread, texts_from_documents, write_corpus
from corpusloom.sources.shared import materialise, new_path


@dataclass(frozen=True)
class Analysis:
    """What the steps of the job leave, for reports and tests."""

    corpus: Corpus
    pairs: DataFrame
    candidates: DataFrame
    occurrences: DataFrame
    collocates: DataFrame


def run_analysis(spark: SparkSession, texts: DataFrame, request: str, stored: DataFrame | None = None) -> Analysis:
    """All steps, lazily, with the rule annotator. ``store_analysis`` writes the corpus for reports to read."""
    return _analysed(spark, texts, ingest.split_sentences(texts), request, stored)


def _analysed(spark: SparkSession, texts: DataFrame, sentences: DataFrame, request: str, stored: DataFrame | None = None) -> Analysis:
    words = analyse.lemmatise(analyse.parse_search_words(spark, request))
    pairs = analyse.new_pairs_only(analyse.request_pairs(texts, words), stored)
    candidates = analyse.candidates_of_request(sentences, words) if stored is None else analyse.candidate_sentences(sentences, pairs)
    annotated = once(candidates, analyse.rule_annotation(F.col("sentence")).alias("tokens"))
    return _assembled(texts, sentences, pairs, candidates, analyse.occurrences(annotated))


def _assembled(texts: DataFrame, sentences: DataFrame, pairs: DataFrame, candidates: DataFrame, occurrences: DataFrame) -> Analysis:
    collocates = analyse.collocates(occurrences)
    corpus = Corpus(
        texts=texts.select("text_id", "title", "author", "year", "genre"),
        sentences=sentences.select("sentence_id", "sentence", "text_id"),
        tokens=analyse.token_counts(occurrences, pairs),
        words=analyse.build_words(collocates),
        cross=analyse.build_cross(collocates),
    )
    return Analysis(corpus, pairs, candidates, occurrences, collocates)


def store_analysis(spark: SparkSession, texts: DataFrame, request: str, path: str) -> Corpus:
    """The five tables under ``path``. Texts are split once and annotated once: sentences and occurrences are files before the tables are built from them."""
    ingest.split_sentences(spread(texts), numbered=not ingest.ids_fit(texts)).write.parquet(f"{path}/_split")
    split = spark.read.parquet(f"{path}/_split")
    analysis = _analysed(spark, texts, split, request)
    analysis.occurrences.write.parquet(f"{path}/_occurrences")
    whole = _assembled(texts, split, analysis.pairs, analysis.candidates, spark.read.parquet(f"{path}/_occurrences")).corpus
    write_corpus(whole, path)
    return read_corpus(spark, path)


def analyse_into(spark: SparkSession, path: str, request: str, text_ids: DataFrame | None = None) -> tuple[store.Version, DataFrame]:
    """A further request on a stored corpus: (version, report). Only pairs of text and lemma that aren't stored are analysed, on the stored
    sentences, and their tokens, words and links become files beside the stored ones. The same request again adds nothing."""
    base = store.read_version(spark, path)
    stored = base.corpus(spark)
    texts = stored.texts if text_ids is None else stored.texts.join(text_ids.select("text_id"), "text_id", "left_semi")
    words = analyse.lemmatise(analyse.parse_search_words(spark, request))
    asked = analyse.request_pairs(texts, words)
    pairs = materialise(analyse.new_pairs_only(asked, stored.tokens), "pairs")
    candidates = analyse.candidate_sentences(stored.sentences, pairs)
    annotated = once(candidates, analyse.rule_annotation(F.col("sentence")).alias("tokens"))
    found = materialise(analyse.occurrences(annotated), "occurrences")
    collocates = analyse.collocates(found)
    version = store.append(spark, base, tokens=analyse.token_counts(found, pairs), words=analyse.build_words(collocates), cross=analyse.build_cross(collocates))
    met = found.select("text_id", F.array("token").alias("targets"))
    return version, analyse.analysis_report(asked, stored.tokens, met)


def add_texts(spark: SparkSession, path: str, texts: DataFrame) -> store.Version:
    """New texts and their sentences into a stored corpus; a title that is stored, or that comes twice, isn't taken in again."""
    base = store.read_version(spark, path)
    fresh = ingest.new_texts_only(texts, base.table(spark, "texts"))
    kept = materialise(fresh.select("text_id", "title", "author", "year", "genre", "text"), "new-texts")
    if not ingest.ids_fit(kept):
        raise ValueError("texts added to a store need ids that sentence ids can be made from: whole numbers below 2**36")
    return store.append(spark, base, texts=kept, sentences=ingest.split_sentences(kept))


_stored: dict[tuple[str, str, str], str] = {}
_made_from: dict[str, int] = {}


def _is_there(spark: SparkSession, path: str) -> bool:
    """Whether the last table that ``store_analysis`` writes is still there; somebody may have cleared the shared folder."""
    try:
        return bool(spark.read.parquet(f"{path}/cross").columns)
    except AnalysisException:
        return False


def input_version(spark: SparkSession, path: str) -> int:
    """A digest of the names, lengths and modification times of the files under a path; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    each = F.xxhash64("path", "length", F.col("modificationTime").cast("double"))
    return files.agg(F.coalesce(F.bit_xor(each), F.lit(0)).alias("v"), F.count("*").alias("n")).select(F.xxhash64("v", "n")).first()[0]


def stored_corpus(spark: SparkSession, sf_dir: str, request: str) -> Corpus:
    """The corpus of generated documents as stored tables: the first query of a Spark application that asks for it writes it to the
    shared folder, and later ones read it there, as long as the files of the documents are those that it was made from."""
    key = (spark.sparkContext.applicationId, sf_dir, request)
    found = input_version(spark, f"{sf_dir}/documents.parquet")
    if key not in _stored or _made_from[_stored[key]] != found or not _is_there(spark, _stored[key]):
        path = new_path(spark, "corpus")
        store_analysis(spark, texts_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), request, path)
        _stored[key], _made_from[path] = path, found
    return read_corpus(spark, _stored[key])


def sentences_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences as the stored corpus has them, straight from the documents: for queries that need nothing else of it."""
    texts = texts_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return ingest.split_sentences(spread(texts), numbered=not ingest.ids_fit(texts)).select("sentence_id", "sentence", "text_id")


def analysis_of_documents(spark: SparkSession, sf_dir: str, request: str) -> Analysis:
    return run_analysis(spark, texts_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), request)
