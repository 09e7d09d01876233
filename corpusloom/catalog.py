"""Registered corpus-lexicon queries; their SQL twins are in ``catalog_sql``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog_sql import EMOTIONS, FIRST, KEYWORDS, MARKERS, PAIR, PATTERNS, SOME, TARGET, VOWELS, WORD, oracle_sql
from corpusloom.functions import features
from corpusloom.functions.text import token_array
from corpusloom.operators import analyse, coverage, ingest, maintain, ranking, report, search
from corpusloom.plans.lexicon import Analysis, add_texts, analyse_into, analysis_of_documents, sentences_of_documents, stored_corpus
from corpusloom.sources import files, postings, store
from corpusloom.sources.corpus import Corpus, spread, texts_from_documents
from corpusloom.sources.shared import new_path

__all__ = ["oracle_sql", "queries"]

REQUEST = ", ".join(KEYWORDS)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return analysis_of_documents(spark, sf_dir, REQUEST)


def _corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return stored_corpus(spark, sf_dir, REQUEST)


def _on_corpus(build: Callable[[Corpus], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(_corpus(spark, sf_dir))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.split_sentences(spread(_texts(spark, sf_dir)), "author")
    return features.sentence_features(search.flag_keywords(rows, KEYWORDS), VOWELS, EMOTIONS, MARKERS)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def author_style_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.author_stats(_features(spark, sf_dir)), "lexical_diversity", "sentence_length", "alliteration_score", "rhythm_score")


def sentence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.flatten_lists(_features(spark, sf_dir)).drop("text_id", "pos"), "lexical_diversity")


def sentence_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas, parts of speech and their counts of the sentences that have a target."""
    rows = _analysis(spark, sf_dir).candidates.withColumn("t", analyse.rule_annotation(F.col("sentence")))
    counts = features.pos_frequency(F.col("t.pos"))
    listed = F.transform(F.array_sort(F.map_keys(counts)), lambda p: F.concat(p, F.lit("="), counts[p].cast("string")))
    return rows.select("sentence_id", F.array_join("t.lemma", " ").alias("lemmas"), F.array_join("t.pos", " ").alias("pos"), F.array_join(listed, ",").alias("pos_counts"))


def new_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir).withColumn("title", F.concat_ws("/", "author", "genre"))
    stored = texts.where("genre = 'fr'")
    return ingest.new_texts_only(texts, stored).select("text_id", "title")


def validate_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = docs.select(F.col("doc_id").alias("text_id"), F.concat(F.lit(" "), F.col("source"), F.lit("\t")).alias("author"), F.when(F.col("lang") == "de", F.col("lang")).otherwise(F.concat(F.lit(" "), F.col("n_chars").cast("string"))).alias("year"))
    ok, bad = ingest.validate_year(raw)
    return ok.select("text_id", "author", "year", F.lit(True).alias("accepted")).unionByName(bad.select("text_id", "author", F.lit(None).cast("int").alias("year"), F.lit(False).alias("accepted")))


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return ingest.labelled(texts).join(ingest.labelled(texts, True).withColumnRenamed("label", "label_year"), "text_id")


def tokens_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).tokens.select("text_id", "token", "token_count")


def words_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return c.words.join(c.tokens.select("text_id", "token_id", "token"), ["text_id", "token_id"]).select("text_id", "token", "pos", "word", "frequency")


def cross_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    linked = c.cross.join(c.words.select("text_id", "word_id", "pos", "word"), ["text_id", "word_id"])
    return linked.join(c.tokens.select("text_id", "token_id", "token"), ["text_id", "token_id"]).select("sentence_id", "text_id", "token", "pos", "word")


def analysis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark, sf_dir)
    stored = _corpus(spark, sf_dir)
    german = stored.texts.where("genre = 'de'").select("text_id")
    return analyse.analysis_report(a.pairs, stored.tokens.where("token_count > 0").join(german, "text_id", "left_semi"), a.candidates)


def new_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested pairs beyond those stored for texts of one language; the request names a word twice."""
    texts = _texts(spark, sf_dir)
    words = analyse.lemmatise(analyse.parse_search_words(spark, f"{REQUEST},, THE "))
    stored = texts.where("genre = 'de'").select("text_id", F.lit("und").alias("token"))
    return analyse.new_pairs_only(analyse.request_pairs(texts, words), stored).select("text_id", "position", "word", "token")


def lemmatised_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon with the languages as forms and sources as lemmas, of which the smallest counts."""
    lexicon = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("form"), F.col("source").alias("lemma"))
    return analyse.lemmatise(analyse.parse_search_words(spark, "EN, fr,, unknown ,de"), lexicon)


def stored_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that have a stored annotation, here those of German texts."""
    c, a = _corpus(spark, sf_dir), _analysis(spark, sf_dir)
    german = c.sentences.join(c.texts.where("genre = 'de'").select("text_id"), "text_id", "left_semi")
    annotations = german.select("sentence_id", analyse.rule_annotation(F.col("sentence")).alias("tokens"))
    return analyse.with_annotations(a.candidates, annotations).select("sentence_id", F.size("tokens").alias("n_tokens"), F.size("targets").alias("n_targets"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalogue lines, every third one with a range of years, read back."""
    t = _texts(spark, sf_dir)
    year = F.col("year").cast("string")
    years = F.when(F.col("text_id") % 3 == 0, F.concat(F.lit("("), year, F.lit("-"), (F.col("year") + 5).cast("string"), F.lit(")"))).otherwise(year)
    line = F.concat(F.col("text_id").cast("string"), F.lit(". "), F.concat_ws(" / ", "title", F.col("author"), F.when(F.col("text_id") % 2 == 0, F.col("genre")), years), F.lit("  "))
    return files.parse_catalogue(t.where("author is not null").select(F.col("text_id").alias("n"), line.alias("value")))


def sentence_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with authors written as CSV and read back."""
    c, path = _corpus(spark, sf_dir), new_path(spark, "sentences-csv")
    rows = search.sentences_with_author(c.sentences, c.cross, c.tokens, c.texts)
    files.write_csv(rows.select(F.col("text_id").alias("TextID"), F.col("author").alias("Author"), F.col("title").alias("Title"), F.col("sentence").alias("Sentence")), path)
    return files.read_sentences_csv(spark, path)


def metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all texts as CSV with JSON columns, read back and decoded."""
    c, path = _corpus(spark, sf_dir), new_path(spark, "metrics-csv")
    r = _report(c)
    files.write_csv(
        r.select(
            F.col("text_id").alias("TextID"), F.col("title").alias("TextTitle"), F.col("author").alias("Text_Author"), F.col("year").alias("Text_year_creation"), "total_sentences", "token_sentences",
            "token_sentence_percent", F.to_json("top_tokens").alias("top_tokens"), F.col("avg_links").alias("avg_words_per_token_sentence"),
            F.col("avg_links_weighted").alias("avg_words_for_token_sentence"), F.to_json("top_pos_stats").alias("top_pos_stats"),
        ),
        path,
    )
    lists = F.size(F.filter(F.map_values("top_pos_stats"), lambda p: p.isNotNull()))
    return _listed_tokens(files.read_metrics_csv(spark, path)).withColumn("n_pos_lists", lists).drop("top_pos_stats")


def wide_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table of texts, a column for each rank, as CSV and read back."""
    c, path = _corpus(spark, sf_dir), new_path(spark, "wide-csv")
    files.write_csv(_rounded(ranking.analytical_table(c.sentences, c.cross, c.tokens, c.words), "avg_words"), path)
    return files.read_wide_csv(spark, path)


def graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph written as node and edge files: edges joined to the labels of both ends."""
    c, path = _corpus(spark, sf_dir), new_path(spark, "graph")
    files.write_graph(*report.token_graph(c.texts, c.tokens), path)
    nodes, edges = (spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges"))
    named = lambda end: nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    return edges.join(named("src"), "src").join(named("dst"), "dst").select("src", "dst", "src_label", "dst_label")


def _hits(c: Corpus) -> DataFrame:
    return search.sentences_with_tokens(c.sentences, c.cross, c.tokens)


def keyword_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.flag_keywords(ingest.split_sentences(spread(_texts(spark, sf_dir))), KEYWORDS).select("sentence_id", "sentence")


def _concordance(distinct: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _corpus(spark, sf_dir)
        return search.concordance(c.cross, c.words, c.tokens, c.sentences, None, TARGET, distinct).select("text_id", "sentence_id", "word", "pos", "shown")

    return run


def conversations_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a second corpus, its roles as authors."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumnRenamed("role", "author")
    return search.by_authors(rows, ["user", "assistant"]).groupBy("author").agg(F.count("*").alias("n"))


def _report(c: Corpus) -> DataFrame:
    return report.text_report(c.texts, c.sentences, c.cross, c.tokens, c.words)


def _listed_tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("top_tokens", F.array_join(F.transform("top_tokens", lambda t: F.concat(t["token"], F.lit(":"), t["count"].cast("string"))), ","))


def _pos_strings(column: str):
    one = lambda p: F.concat(p["part_of_speech"], F.lit(":"), p["frequency"].cast("string"), F.lit("["), F.array_join(p["examples"], " "), F.lit("]"))
    return F.array_join(F.transform(column, one), ",")


def pos_per_token(c: Corpus) -> DataFrame:
    return report.pos_per_token(c.tokens, c.words).withColumn("pos_list", _pos_strings("pos_list"))


def pos_map(c: Corpus) -> DataFrame:
    entries = report.pos_map(c.tokens, c.words).select("text_id", F.explode("top_pos_stats").alias("key", "pos_list"))
    return entries.withColumn("pos_list", _pos_strings("pos_list"))


def text_report(c: Corpus) -> DataFrame:
    out = _listed_tokens(_report(c))
    return out.withColumn("n_pos_lists", F.size(F.filter(F.map_values("top_pos_stats"), lambda p: p.isNotNull()))).drop("top_pos_stats")


def _first_request(c: Corpus) -> Corpus:
    """The corpus as a request for the words of FIRST left it."""
    tokens = c.tokens.where(F.col("token").isin(*FIRST))
    own = tokens.select("text_id", "token_id")
    return replace(c, tokens=tokens, words=c.words.join(own, ["text_id", "token_id"], "left_semi"), cross=c.cross.join(own, ["text_id", "token_id"], "left_semi"))


def second_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that has had one request gets a second one, twice: what it holds in the end, and what the second run added."""
    path = new_path(spark, "store")
    store.create_store(spark, _first_request(_corpus(spark, sf_dir)), path)
    analyse_into(spark, path, REQUEST)
    version, report_ = analyse_into(spark, path, REQUEST)
    c = version.corpus(spark)
    n = lambda df, name: df.groupBy("text_id", "token_id").agg(F.count("*").alias(name))
    full = c.tokens.join(n(c.words, "n_words"), ["text_id", "token_id"], "left").join(n(c.cross, "n_cross"), ["text_id", "token_id"], "left").join(report_, ["text_id", "token"])
    return full.select("text_id", "token", "token_count", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_cross", F.lit(0)).alias("n_cross"), "status", F.lit(version.number).alias("version"))


def _summary(c: Corpus) -> DataFrame:
    parts = [getattr(c, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("text_id").alias("ids")) for name in ("texts", "sentences", "tokens", "words", "cross")]
    return reduce(DataFrame.unionByName, parts)


def stored_drop_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German texts dropped from a store: the tables after it, and the rows of the version before, which stays."""
    path = new_path(spark, "store")
    first = store.create_store(spark, _corpus(spark, sf_dir), path)
    last = store.drop_stored_texts(spark, path, first.table(spark, "texts").where("genre = 'de'"))
    before = _summary(store.read_store(spark, path, first.number)).select("name", F.col("n").alias("n_before"))
    counted = spark.createDataFrame(sorted(last.rows.items()), "name string, n_counted long")
    return _summary(last.corpus(spark)).join(before, "name").join(counted, "name")


def stored_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One occurrence of every distinct entry removed from a store: what is left per token."""
    path = new_path(spark, "store")
    first = store.create_store(spark, _corpus(spark, sf_dir), path)
    left = store.remove_stored_occurrences(spark, path, first.table(spark, "cross").select("token_id", "sentence_id", "word_id").distinct()).corpus(spark)
    links = left.cross.groupBy("text_id", "token_id").agg(F.count("*").alias("n"))
    return left.tokens.join(links, ["text_id", "token_id"], "left").select("text_id", "token", "token_count", F.coalesce("n", F.lit(0)).alias("n_cross"))


def added_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of the French texts takes in all: sentences per language of what it holds then."""
    c, path, texts = _corpus(spark, sf_dir), new_path(spark, "store"), _texts(spark, sf_dir)
    french = c.texts.where("genre = 'fr'")
    keep = lambda df: df.join(french.select("text_id"), "text_id", "left_semi")
    store.create_store(spark, Corpus(french, *(keep(df) for df in (c.sentences, c.tokens, c.words, c.cross))), path)
    full = add_texts(spark, path, texts).corpus(spark)
    return full.texts.join(full.sentences, "text_id", "left").groupBy("genre").agg(F.countDistinct("text_id").alias("n_texts"), F.count("sentence_id").alias("n_sentences"))


def stored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate sentences of pairs that a store hasn't had, with wildcards in the words."""
    c = _corpus(spark, sf_dir)
    words = analyse.lemmatise(analyse.parse_search_words(spark, ", ".join(PATTERNS)))
    pairs = analyse.new_pairs_only(analyse.request_pairs(c.texts.where("genre = 'de'"), words), c.tokens)
    return analyse.candidate_sentences(c.sentences, pairs).select("sentence_id", F.array_join(F.array_sort("targets"), ",").alias("targets"))


def concordance_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was typed is a form of the target in a lexicon, here names of languages; it is what is highlighted."""
    c = _corpus(spark, sf_dir)
    lexicon = c.texts.select(F.col("genre").alias("form"), F.lit(TARGET).alias("lemma"))
    return search.concordance(c.cross, c.words, c.tokens, c.sentences, None, "de", lexicon=lexicon).select("text_id", "sentence_id", "word", "pos", "shown")


def concordance_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concordance of the target from postings that are written and read again."""
    c, path = _corpus(spark, sf_dir), new_path(spark, "postings")
    postings.write_postings(c, path)
    return search.concordance_of_postings(postings.read_postings(spark, path), c.sentences, None, TARGET, distinct=False).select("text_id", "sentence_id", "word", "pos", "shown")


def sentences_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as plain files, one for each part of the table, read by ranges of lines: how often each sentence is there."""
    path = new_path(spark, "texts")
    _texts(spark, sf_dir).where("text is not null").select(F.col("text").alias("value")).write.text(path)
    return files.read_sentences(spark, path).groupBy("sentence").agg(F.count("*").alias("n"))


def _first_words(texts: DataFrame) -> DataFrame:
    return texts.select(F.lower(F.regexp_extract("text", r"[\p{L}\p{N}_]+", 0)).alias("word")).where("word <> ''").distinct()


def emotional_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a lexicon that is a table: the first words of all texts, weighed by their length."""
    lexicon = _first_words(_texts(spark, sf_dir)).select("word", (F.length("word") % 5 - 2).alias("weight"))
    rows = sentences_of_documents(spark, sf_dir).select("sentence_id", token_array(F.col("sentence")).alias("tokens"))
    return features.emotional_scores(rows, lexicon).select("sentence_id", "emotional_score")


def many_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that have one of a table of words as a substring: the first words of all texts."""
    return search.flag_words(sentences_of_documents(spark, sf_dir), _first_words(_texts(spark, sf_dir))).select("sentence_id")


def extraction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two extractions, counted while they are written."""
    c, out = _corpus(spark, sf_dir), []
    for name, rows in (("linked", _hits(c)), ("context", search.sentences_with_context(c.sentences, _hits(c)))):
        watched, seen = store.counted(rows.select("text_id", "sentence"))
        files.write_csv(watched, new_path(spark, f"{name}-csv"))
        out.append((name, seen()))
    return spark.createDataFrame(out, "name string, n long")


def drop_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    left = maintain.drop_texts(c, c.texts.where("genre = 'de'"))
    out = None
    for name in ("texts", "sentences", "tokens", "words", "cross"):
        part = getattr(left, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("text_id").alias("ids"))
        out = part if out is None else out.unionByName(part)
    return out


def remove_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One occurrence of every distinct entry removed: what is left per token."""
    c = _corpus(spark, sf_dir)
    left = maintain.remove_occurrences(c, c.cross.select("token_id", "sentence_id", "word_id").distinct())
    links = left.cross.groupBy("text_id", "token_id").agg(F.count("*").alias("n"))
    return left.tokens.join(links, ["text_id", "token_id"], "left").select("text_id", "token", "token_count", F.coalesce("n", F.lit(0)).alias("n_cross"))


def remove_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of the target token in German texts go by their ids; the count of one named token is lowered by their number."""
    c = _corpus(spark, sf_dir)
    german = c.texts.where("genre = 'de'").select("text_id")
    gone = c.cross.join(c.tokens.where(F.col("token") == TARGET).join(german, "text_id", "left_semi").select("token_id"), "token_id", "left_semi")
    token_id = spark.range(1).select(F.xxhash64(F.lit(PAIR[0]).cast("long"), F.lit(TARGET))).first()[0]
    left = maintain.remove_cross(c, token_id, gone.select(F.col("cross_id").cast("string").alias("cross_id")).unionByName(spark.range(1).select(F.lit("no id").alias("cross_id"))))
    links = left.cross.groupBy("text_id", "token_id").agg(F.count("*").alias("n"))
    return left.tokens.join(links, ["text_id", "token_id"], "left").select("text_id", "token", "token_count", F.coalesce("n", F.lit(0)).alias("n_cross"))


def explode_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    contexts = items.groupBy(F.col("l_orderkey").alias("word_id")).agg(F.array_join(F.collect_list(F.col("l_partkey").cast("string")), ", ").alias("sentence_ids"))
    links = items.where("l_linenumber = 1").select(F.col("l_orderkey").alias("word_id"), F.col("l_partkey").alias("sentence_id"))
    return maintain.explode_links(contexts, links)


def _some(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("token").isin(*SOME))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    on = _on_corpus
    return {
        "split_sentences": lambda s, d: ingest.split_sentences(spread(_texts(s, d))),
        "author_style_stats": author_style_stats,
        "author_overview": lambda s, d: _rounded(features.author_overview(_features(s, d)), "lexical_diversity"),
        "author_list": lambda s, d: features.author_list(_features(s, d)),
        "sentence_features": sentence_features,
        "lemmatised_request": lemmatised_request,
        "stored_annotations": stored_annotations,
        "catalogue": catalogue,
        "sentence_csv": sentence_csv,
        "metrics_csv": metrics_csv,
        "wide_csv": wide_csv,
        "graph_files": graph_files,
        "remove_cross": remove_cross,
        "sentence_annotation": sentence_annotation,
        "new_texts": new_texts,
        "validate_year": validate_year,
        "list_texts": lambda s, d: ingest.list_texts(_texts(s, d)),
        "text_labels": text_labels,
        "tokens_table": tokens_table,
        "words_table": words_table,
        "cross_table": cross_table,
        "analysis_report": analysis_report,
        "new_pairs": new_pairs,
        "sentences_with_tokens": on(lambda c: _hits(c).select("text_id", "sentence_id", "sentence")),
        "sentences_with_author": on(lambda c: search.sentences_with_author(c.sentences, c.cross, c.tokens, c.texts.where("genre <> 'de'"))),
        "context_in_text": on(lambda c: search.sentences_with_context(c.sentences, _hits(c))),
        "context_global": on(lambda c: search.sentences_with_context(c.sentences, _hits(c), scope="global")),
        "keyword_flags": keyword_flags,
        "keyword_sentences": on(lambda c: search.keyword_sentences(c.sentences, c.cross, c.texts, KEYWORDS)),
        "concordance": _concordance(True),
        "concordance_all": _concordance(False),
        "tokens_of_text": on(lambda c: search.tokens_of_text(c.tokens, PAIR[0]).select("token", "token_count")),
        "words_of_token": on(lambda c: search.words_of_token(c.words, c.tokens, TARGET).select("text_id", "pos", "word", "frequency")),
        "sentences_of_word": on(lambda c: search.sentences_of_word(c.cross, c.words, c.tokens, c.sentences, WORD).select("text_id", "sentence_id", "sentence")),
        "top_adjectives": on(lambda c: search.top_words_by_pos(c.words).select("text_id", "word", "frequency")),
        "conversations_by_role": conversations_by_role,
        "text_coverage": on(lambda c: coverage.text_coverage(c.texts, c.sentences, c.cross, c.tokens)),
        "text_coverage_joined": on(lambda c: coverage.text_coverage_joined(c.sentences, c.cross, c.tokens)),
        "title_coverage": on(lambda c: coverage.title_coverage(c.texts, c.sentences, c.cross)),
        "avg_words_per_sentence": on(lambda c: _rounded(coverage.avg_words_per_sentence(c.cross), "avg_words")),
        "link_averages": on(lambda c: coverage.link_averages(c.cross, c.tokens)),
        "coverage_vs_length": on(lambda c: coverage.coverage_vs_length(c.texts, c.sentences, c.cross, c.tokens)),
        "token_totals": on(lambda c: ranking.token_totals(c.tokens)),
        "top_tokens": on(lambda c: ranking.top_tokens(c.tokens)),
        "pos_totals": on(lambda c: ranking.pos_totals(c.words, c.cross)),
        "top_pos": on(lambda c: ranking.top_pos(c.words, c.cross)),
        "analytical_table": on(lambda c: _rounded(ranking.analytical_table(c.sentences, c.cross, c.tokens, c.words), "avg_words")),
        "compare_texts": on(lambda c: ranking.compare_texts(c.words, _some(c.tokens), *PAIR)),
        "top_words_with_context": on(lambda c: ranking.top_words_with_context(c.words, c.cross, c.sentences, _some(c.tokens))),
        "tokens_json": on(lambda c: _listed_tokens(report.tokens_json(c.tokens))),
        "pos_per_token": on(pos_per_token),
        "pos_map": on(pos_map),
        "text_report": on(text_report),
        "corpus_totals": on(lambda c: _rounded(report.corpus_totals(_report(c)), "avg_percent", "avg_links")),
        "top_tokens_corpus": on(lambda c: report.top_tokens_corpus(_report(c))),
        "pos_distribution": on(lambda c: report.pos_distribution(_report(c))),
        "author_timeline": on(lambda c: report.author_timeline(c.texts)),
        "graph_nodes": on(lambda c: report.token_graph(c.texts, c.tokens)[0]),
        "graph_edges": on(lambda c: report.token_graph(c.texts, c.tokens)[1]),
        "drop_texts": drop_texts,
        "second_analysis": second_analysis,
        "stored_drop_texts": stored_drop_texts,
        "stored_removals": stored_removals,
        "added_texts": added_texts,
        "stored_candidates": stored_candidates,
        "concordance_lemma": concordance_lemma,
        "emotional_lexicon": emotional_lexicon,
        "many_words": many_words,
        "extraction_counts": extraction_counts,
        "concordance_index": concordance_index,
        "sentences_of_files": sentences_of_files,
        "remove_occurrences": remove_occurrences,
        "explode_links": explode_links,
    }
