"""Readers and writers: round trips, odd input, and the annotation hook."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import features
from corpusloom.operators import analyse, ingest, maintain, report
from corpusloom.plans.lexicon import run_analysis, store_analysis
from corpusloom.sources import corpus, files


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


TEXTS = "text_id long, title string, author string, year int, genre string, text string"


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        (1, "T1", "A1", 1863, "роман", "The smoke rose. Nothing.\nThe acrid smoke, and smoke again!"),
        (2, "T2", "A2", 1873, "роман", 'A sweet smell "like" honey? Smoke.'),
        (3, "T3", None, None, None, ""),
        (4, "T4", "A1", 1900, None, None),
    ]
    return run_analysis(spark, spark.createDataFrame(rows, TEXTS), "smoke, smell, absent").corpus


def test_texts_are_read_whole_and_cleaned(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  Первая строка.\n\nВторая\x00 строка!\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("", encoding="utf-8")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "Первая строка.\n\nВторая строка!"
    assert got.get("b.txt", "") == ""


def test_catalogue_lines(spark):
    lines = [
        "## Heading", "1. Война и мир / Лев Толстой / роман / 1863  ", "", "2. Записки / Иван Тургенев / (1847-1852)",
        "3. Отцы / и / дети / Иван Тургенев / роман / 1860", "no number / x / 1", "4. Title only / 1900", "5. Чайка / Антон Чехов / пьеса / 1895-1896", "---", "6. After / The End / роман / 1999",
    ]
    got = files.parse_catalogue(spark.createDataFrame(list(enumerate(lines)), "n long, value string"))
    assert rows_of(got) == sorted(
        [
            (1, "Война и мир", "Лев Толстой", "роман", 1863, 1863), (2, "Записки", "Иван Тургенев", None, 1847, 1852),
            (3, "Отцы / и / дети", "Иван Тургенев", "роман", 1860, 1860), (5, "Чайка", "Антон Чехов", "пьеса", 1895, 1896),
        ],
        key=repr,
    )


def test_csv_keeps_quotes_commas_line_feeds_and_nulls(spark, tmp_path):
    rows = [(1, "A, B", 'T "x"', 'He said: "no, never"\nand left'), (2, None, "T", "plain"), (3, "é", "–", "a;b\\c")]
    files.write_csv(spark.createDataFrame(rows, files.SENTENCE_CSV), str(tmp_path / "s"))
    assert rows_of(files.read_sentences_csv(spark, str(tmp_path / "s"))) == sorted(rows, key=repr)


def test_json_columns_with_single_quotes_and_broken_text(spark):
    rows = [("[{'token': 'дым', 'count': 3}]", "{'top_pos_дым': [{'part_of_speech': 'NOUN', 'frequency': 1, 'examples': ['мёд']}]}"), ("broken", "{"), (None, None)]
    got = files.parse_json_columns(spark.createDataFrame(rows, "top_tokens string, top_pos_stats string")).collect()
    assert [(t.token, t["count"]) for t in got[0].top_tokens] == [("дым", 3)]
    assert got[0].top_pos_stats["top_pos_дым"][0].examples == ["мёд"]
    assert [(r.top_tokens, r.top_pos_stats) for r in got[1:]] == [([], {}), ([], {})]


def test_corpus_files_hold_what_was_written(spark, small, tmp_path):
    corpus.write_corpus(small, str(tmp_path / "c"))
    back = corpus.read_corpus(spark, str(tmp_path / "c"))
    for name in corpus.SCHEMAS:
        assert rows_of(getattr(back, name)) == rows_of(getattr(small, name))
    with pytest.raises(Exception, match="(?i)exist"):
        corpus.write_corpus(small, str(tmp_path / "c"))


def test_a_stored_analysis_equals_the_lazy_one(spark, small, tmp_path):
    texts = small.texts.withColumn("text", F.when(F.col("text_id") == 1, "The smoke rose. Nothing.\nThe acrid smoke, and smoke again!").when(F.col("text_id") == 2, 'A sweet smell "like" honey? Smoke.'))
    stored = store_analysis(spark, texts, "smoke, smell, absent", str(tmp_path / "s"))
    for name in corpus.SCHEMAS:
        assert rows_of(getattr(stored, name)) == rows_of(getattr(small, name))
    assert sorted((r.text_id, r.token, r.token_count) for r in stored.tokens.where("token_count > 0").collect()) == [(1, "smoke", 3), (2, "smell", 1), (2, "smoke", 1)]


def test_a_corpus_is_stored_once_and_again_when_it_is_gone(spark):
    import shutil

    from corpusloom.plans import lexicon

    data = "/root/testdata/sf0.001"
    first = lexicon.stored_corpus(spark, data, "the, and")
    key = (spark.sparkContext.applicationId, data, "the, and")
    path, n = lexicon._stored[key], first.cross.count()
    assert n and lexicon.stored_corpus(spark, data, "the, and").cross.count() == n and lexicon._stored[key] == path
    shutil.rmtree(path.removeprefix("file://").removeprefix("file:"))
    assert lexicon.stored_corpus(spark, data, "the, and").cross.count() == n and lexicon._stored[key] != path


def test_corpus_through_a_database(spark, small, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    names = {"cross": '"cross"'}
    corpus.write_corpus_jdbc(small, url, driver, connections=2, names=names)
    back = corpus.read_corpus_jdbc(spark, url, driver, {"texts": ("text_id", 1, 4, 2)}, names)
    assert back.texts.rdd.getNumPartitions() == 2
    for name in corpus.SCHEMAS:
        assert rows_of(getattr(back, name).select(*getattr(small, name).columns)) == rows_of(getattr(small, name))


def test_graph_files(spark, small, tmp_path):
    files.write_graph(*report.token_graph(small.texts, small.tokens), str(tmp_path / "g"))
    assert rows_of(spark.read.parquet(str(tmp_path / "g/edges"))) == [("text_1", "smoke", "contains"), ("text_2", "smell", "contains"), ("text_2", "smoke", "contains")]
    assert ("smoke", "smoke (1)", "token") in rows_of(spark.read.parquet(str(tmp_path / "g/nodes")))


def test_lexicon_gives_lemmas(spark):
    words = analyse.parse_search_words(spark, "Дымом, запах ,, ДЫМ")
    lexicon = spark.createDataFrame([("дымом", "дым"), ("Дымом", "дымо"), ("иной", "другой")], "form string, lemma string")
    assert rows_of(analyse.lemmatise(words, lexicon)) == sorted([(0, "дымом", "дым"), (1, "запах", "запах"), (3, "дым", "дым")], key=repr)
    with pytest.raises(ValueError):
        analyse.parse_search_words(spark, " , ")


def test_a_model_annotates_through_the_hook(spark):
    def model(batches):
        for batch in batches:
            tokens = [[{"i": k, "text": w, "lemma": w.lower(), "pos": "X", "head": 0} for k, w in enumerate(s.split())] for s in batch["sentence"]]
            yield batch.assign(tokens=pd.Series(tokens, index=batch.index, dtype=object))

    rows = spark.createDataFrame([(1, 1, "The Smoke", ["smoke"]), (1, 2, "none", ["smoke"])], "text_id long, sentence_id long, sentence string, targets array<string>")
    annotated = analyse.annotate(rows, model)
    found = {(r.sentence_id, r.token): (r.n, [(c.pos, c.word) for c in r.found]) for r in analyse.occurrences(annotated).collect()}
    assert found == {(1, "smoke"): (1, []), (2, "smoke"): (0, [])}
    stored = annotated.select("sentence_id", "tokens").where("sentence_id = 1")
    assert [r.sentence_id for r in analyse.with_annotations(rows, stored).collect()] == [1]


def test_remove_cross_lowers_the_named_token_alone(spark, small):
    ids = [str(r.cross_id) for r in small.cross.where("text_id = 1").collect()]
    token = small.tokens.where("text_id = 1 and token = 'smoke'").first().token_id
    left = maintain.remove_cross(small, token, spark.createDataFrame([(i,) for i in [*ids, ids[0], "abc", "", None]], "cross_id string"))
    assert left.cross.where("text_id = 1").count() == 0 and left.cross.count() == small.cross.count() - len(ids)
    assert left.tokens.where(F.col("token_id") == token).first().token_count == max(0, 3 - len(ids))
    assert rows_of(left.tokens.where(F.col("token_id") != token)) == rows_of(small.tokens.where(F.col("token_id") != token))


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_texts_are_numbered_whatever_the_partitions(spark, coalesce):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        texts = spark.range(300_000).select((F.col("id") * 7 % 300_000 * 11 - 5_000).alias("text_id")).withColumn("title", F.concat(F.repeat(F.lit("t"), 300), F.col("text_id").cast("string")))
        got = ingest.list_texts(texts)
        wrong = got.where((F.col("number") - 1) * 11 - 5_000 != F.col("text_id")).count()
        assert (wrong, got.count()) == (0, 300_000)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_text_of_many_sentences_keeps_its_order(spark):
    rows = ingest.split_sentences(spark.createDataFrame([(5, "a. " * 150_000), (6, "b.")], "text_id long, text string"))
    assert rows.count() == 150_001 and rows.select("sentence_id").distinct().count() == 150_001
    assert rows.where("text_id = 5").agg(F.max("sentence_id")).first()[0] < rows.where("text_id = 6").first().sentence_id


def test_features_of_odd_sentences(spark):
    rows = [("Сладкий дым, как мёд. Горький!", "A"), ("", "A"), (None, "A"), ("...", "B"), ("ааа аб ба " * 200, None)]
    got = {r.sentence[:7]: r for r in features.sentence_features(spark.createDataFrame(rows, "sentence string, author string")).collect()}
    assert set(got) == {"Сладкий", "...", "ааа аб "}
    first = got["Сладкий"]
    assert (first.emotional_score, first.contains_metaphor, first.alliteration_score, first.sentence_length, first.rhythm_score) == (0, True, 1, 8, 7)
    assert got["..."].alliteration_score == 0 and len(got["ааа аб "].sentence) == 500 and got["ааа аб "].alliteration_score == 100
