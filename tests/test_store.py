"""The versioned store: appends, deletions, conflicts; bucketed tables; plans of the report."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import features
from corpusloom.functions.text import token_array
from corpusloom.operators import analyse, ingest, maintain, report, search
from corpusloom.plans import lexicon
from corpusloom.sources import corpus, store

#: Queries that need nothing of the corpus but its sentences.
SENTENCES_ALONE = ("emotional_lexicon", "many_words")
TEXTS = "text_id long, title string, author string, year int, genre string, text string"
ROWS = [
    (1, "T1", "A1", 1863, "роман", "The smoke rose. Nothing.\nThe acrid smoke, and smoke again!"), (2, "T2", "A2", 1873, "роман", 'A sweet smell "like" honey? Smoke.'),
    (3, "T3", None, None, None, ""), (4, "T4", "A1", 1900, None, None), *((k, f"T{k}", "A", 1900, "x", f"Smoke number {k}. The smell of it. End.") for k in range(5, 40)),
]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same(a, b):
    for name in corpus.SCHEMAS:
        assert rows_of(getattr(a, name).select(*getattr(b, name).columns)) == rows_of(getattr(b, name)), name


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(ROWS, TEXTS)


@pytest.fixture
def stored(spark, texts, tmp_path):
    path = str(tmp_path / "store")
    return path, store.create_store(spark, lexicon.run_analysis(spark, texts, "smoke, absent").corpus, path, buckets=8)


def test_second_request_adds_new_pairs_only_and_a_repeat_nothing(spark, texts, stored):
    path, first = stored
    second, told = lexicon.analyse_into(spark, path, "smell, smoke, the")
    same(second.corpus(spark), lexicon.run_analysis(spark, texts, "smoke, absent, smell, the").corpus)
    assert set(first.files) < set(second.files) and second.number == 2
    assert {(r.token, r.status) for r in told.where("text_id = 1").collect()} == {("smoke", "exists"), ("smell", "not found"), ("the", "done")}
    again, told = lexicon.analyse_into(spark, path, "the, smell")
    assert again == second and {r.status for r in told.collect()} == {"exists"}
    assert second.rows == {name: getattr(second.corpus(spark), name).count() for name in corpus.SCHEMAS}
    same(store.read_store(spark, path, 1), lexicon.run_analysis(spark, texts, "smoke, absent").corpus)
    few, _ = lexicon.analyse_into(spark, path, "honey", spark.createDataFrame([(2,), (99,)], "text_id long"))
    assert rows_of(few.table(spark, "tokens").where("token = 'honey'").select("text_id", "token_count")) == [(2, 1)]


def test_dropped_texts_leave_other_files_alone(spark, stored):
    path, first = stored
    gone = spark.createDataFrame([(2,), (2,), (77,), (None,)], "text_id long")
    want = maintain.drop_texts(first.corpus(spark), gone)
    last = store.drop_stored_texts(spark, path, gone)
    same(last.corpus(spark), want)
    bucket = spark.createDataFrame([(2,)], "text_id long").select(store.bucket_of(8)).first()[0]
    assert {f for f in first.files if f[1] != bucket} == {f for f in last.files if f[1] != bucket}
    assert not {f for f in first.files if f[1] == bucket and f[0] in ("texts", "sentences", "tokens")} & set(last.files)
    # the text has no words and links, so those files stay as well
    assert {f for f in first.files if f[0] in ("words", "cross")} <= set(last.files) and last.rows["texts"] == len(ROWS) - 1
    assert first.table(spark, "texts").count() == len(ROWS)
    assert store.drop_stored_texts(spark, path, gone) == last


def test_links_of_other_texts_to_a_dropped_one_go_too(spark, tmp_path):
    tables = {
        "texts": [(1, "a", None, None, None), (2, "b", None, None, None)], "sentences": [(1, "s", 1), (2, "t", 2)], "tokens": [(1, "x", 1, 1), (2, "x", 2, 2)],
        "words": [(1, 1, "w", "N", 1, 1), (2, 2, "w", "N", 1, 2)], "cross": [(1, 1, 1, 1, 1), (2, 2, 1, 2, 2), (3, 2, 2, 2, 1), (4, 2, 2, 2, 2)],
    }
    first = store.create_store(spark, corpus.Corpus(**{n: spark.createDataFrame(tables[n], s) for n, s in corpus.SCHEMAS.items()}), str(tmp_path / "s"), buckets=64)
    last = store.drop_stored_texts(spark, first.path, spark.createDataFrame([(1,)], "text_id long")).corpus(spark)
    assert rows_of(last.cross) == [(4, 2, 2, 2, 2)] and rows_of(last.tokens) == [(2, "x", 2, 2)]


def test_occurrences_and_links_removed_from_a_store(spark, stored):
    path, first = stored
    c = first.corpus(spark)
    entry = c.cross.where("text_id = 1").limit(1)
    want = maintain.remove_occurrences(c, entry)
    last = store.remove_stored_occurrences(spark, path, entry)
    same(last.corpus(spark), want)
    assert {f for f in first.files if f[0] in ("texts", "sentences", "words")} == {f for f in last.files if f[0] in ("texts", "sentences", "words")}
    token = c.tokens.where("text_id = 5 and token = 'smoke'").first().token_id
    ids = c.cross.where("text_id in (5, 6)").select(F.col("cross_id").cast("string").alias("cross_id")).unionByName(spark.createDataFrame([("no",)], "cross_id string"))
    want = maintain.remove_cross(last.corpus(spark), token, ids)
    same(store.remove_stored_cross(spark, path, token, ids).corpus(spark), want)


def test_a_version_appears_whole_or_not_at_all(spark, stored, tmp_path):
    path, first = stored
    more = first.table(spark, "tokens").limit(1)
    # a job that died after staging, and one that left the folder of a manifest, have changed nothing
    store._staged(more, path, "tokens", 8)
    (tmp_path / "store/versions/v=2").mkdir()
    assert store.read_version(spark, path) == first
    second = store.append(spark, first, tokens=more)
    assert second.number == 3 and store.versions(spark, path) == [1, 3] and second.table(spark, "tokens").count() == first.table(spark, "tokens").count() + 1
    with pytest.raises(store.Conflict):  # somebody who still works on the first version
        store.append(spark, first, tokens=more)
    with pytest.raises(ValueError):
        store.read_version(spark, path, 2)
    with pytest.raises(ValueError):
        store.create_store(spark, first.corpus(spark), path)


def test_added_texts_are_those_of_new_titles(spark, texts, stored):
    path, first = stored
    new = spark.createDataFrame([(100, "T1", "x", 1, "g", "Known title."), (101, "New", "x", 1, "g", "One. Two."), (102, "New", "x", 1, "g", "Twice.")], TEXTS)
    last = lexicon.add_texts(spark, path, new)
    assert rows_of(last.table(spark, "texts").join(first.table(spark, "texts"), "text_id", "left_anti").select("text_id", "title")) == [(101, "New")]
    assert rows_of(last.table(spark, "sentences").where("text_id = 101").select("sentence")) == [("One.",), ("Two.",)]
    assert lexicon.add_texts(spark, path, new) == last
    with pytest.raises(ValueError):
        lexicon.add_texts(spark, path, new.withColumn("text_id", F.lit(1 << 60)).withColumn("title", F.lit("far")))


def test_a_stored_corpus_follows_its_input(spark, tmp_path):
    def put(n):
        spark.range(n).selectExpr("id doc_id", "'the word' text", "'s' source", "'en' lang").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))

    put(20)
    first = lexicon.stored_corpus(spark, str(tmp_path), "the")
    assert first.texts.count() == 20
    where = dict(lexicon._stored)
    assert lexicon.stored_corpus(spark, str(tmp_path), "the").texts.count() == 20 and lexicon._stored == where
    put(5)
    assert lexicon.stored_corpus(spark, str(tmp_path), "the").texts.count() == 5


def test_any_id_has_sentences_and_a_number(spark):
    rows = [(2**62, "b", "One. Two."), (-(2**62), "a", "Three."), (None, "d", "Four."), (None, "c", "Five."), (7, "e", "Six."), (7, "e", "Seven.")]
    far = spark.createDataFrame(rows, "text_id long, title string, text string")
    assert rows_of(ingest.list_texts(far).select("number", "title")) == [(1, "a"), (2, "e"), (3, "e"), (4, "b"), (5, "c"), (6, "d")]
    assert not ingest.ids_fit(far) and ingest.ids_fit(far.where("text_id = 7"))
    split = ingest.split_sentences(far, numbered=True).collect()
    assert len({r.sentence_id for r in split}) == 7 and [r.sentence for r in sorted(split, key=lambda r: r.sentence_id)][0] == "Three."
    assert [(r.text_id, r.pos) for r in sorted(split, key=lambda r: r.sentence_id) if r.text_id == 2**62] == [(2**62, 0), (2**62, 1)]
    plain = ingest.split_sentences(far).collect()
    assert {r.sentence: r.sentence_id for r in plain} == {"One.": None, "Two.": None, "Three.": None, "Four.": None, "Five.": None, "Six.": 7 << 27, "Seven.": 7 << 27}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.fixture
def static(spark):
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_bucketed_tables_join_by_text_without_exchange(static, texts, stored, tmp_path):
    spark, (_, first) = static, stored
    c, path = first.corpus(static), str(tmp_path / "bucketed")
    corpus.write_corpus_bucketed(c, path, 4)
    for name in corpus.SCHEMAS:
        spark.sql(f"DROP TABLE {corpus._bucketed_name(path, name)}")  # as in another session
    b = corpus.read_corpus_bucketed(spark, path, 4)
    same(b, c)
    whole, plain = (report.text_report(x.texts, x.sentences, x.cross, x.tokens, x.words) for x in (b, c))
    assert [str(r) for r in whole.collect()] == [str(r) for r in plain.collect()]
    assert exchanges(plain) <= 8
    joined = b.texts.join(b.sentences, "text_id").join(b.cross, "text_id").join(b.tokens, ["text_id", "token_id"]).groupBy("text_id").count()
    assert exchanges(joined) == 0 and exchanges(whole) < exchanges(plain)


def test_context_is_a_window(static, stored):
    c = stored[1].corpus(static)
    assert exchanges(search.sentences_with_context(c.sentences, c.sentences.where("sentence_id % 3 = 0"))) <= 3


def test_ids_spread_over_all_bits_have_places(spark):
    rng = random.Random(5)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(400)] + list(range(-1500, 1500, 7)) + [2**63 - 1, -(2**63), 2**40, 2**40 + 1]
    texts = spark.createDataFrame([(k, f"t{k}") for k in ids] + [(None, "b"), (None, "a")], "text_id long, title string")
    got = sorted(map(tuple, ingest.list_texts(texts).collect()))
    assert got == [*((n, k, f"t{k}") for n, k in enumerate(sorted(ids), 1)), (len(ids) + 1, None, "a"), (len(ids) + 2, None, "b")]
    lengths = {k: 1 + rng.randrange(4) for k in ids}
    places = [(n, k, f"{k} {n}") for n, k in enumerate(k for k in sorted(ids) for _ in range(lengths[k]))]
    sentences = spark.createDataFrame(places, "sentence_id long, text_id long, sentence string")
    hits = {n for n, _, _ in places if rng.random() < 0.05}
    marked = sentences.where(F.col("sentence_id").isin(list(hits)))
    want = sorted(((k, s) for n, k, s in places if any(n + d in hits for d in (-2, -1, 0, 1, 2))), key=repr)
    assert rows_of(search.sentences_with_context(sentences, marked, scope="global")) == want


def test_many_words_equal_the_chain(spark):
    rng = random.Random(1)
    letters = "abcdeéяж %_."
    sentences = spark.createDataFrame([(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))).upper()) for k in range(300)] + [(900, None)], "sentence_id long, sentence string")
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(200)] + ["", "Éя", "zz", "a" * 500]
    table = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string")
    want = rows_of(search.flag_keywords(sentences, [w for w in words if w]).select("sentence_id"))
    assert rows_of(search.flag_words(sentences, table).select("sentence_id")) == want
    low = [(r.sentence_id, w) for r in sentences.collect() for w in {w.lower() for w in words if w} if r.sentence is not None and w in r.sentence.lower()]
    assert rows_of(search.words_in_sentences(sentences, table)) == sorted(low, key=repr)
    twice = sentences.unionByName(spark.createDataFrame([(7, "ZZ ÉЯ"), (None, "zz")], sentences.schema))
    joined = rows_of(search.words_in_sentences(twice, table, broadcast_words=0))
    assert joined == rows_of(search.words_in_sentences(twice, table)) and (None, "zz") in joined and (7, "éя") in joined
    assert rows_of(search.flag_words(sentences, table, broadcast_words=0).select("sentence_id")) == want
    large = table.unionByName(spark.range(50_000).selectExpr("concat('q', id) word"))
    assert rows_of(search.flag_words(sentences, large).select("sentence_id")) == want
    assert search.flag_words(sentences, table.limit(0)).count() == 0


def test_least_words_stand_for_the_list(spark):
    words = ["Smoke", "smo", "the", "other", "ab", "b", "x" * 70, "x" * 71 + "Q", "zq", None, ""]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    least, others = search.least_words(table)
    assert (least, rows_of(others)) == (["b", "zq", "smo", "the"], [("x" * 70,), ("x" * 71 + "q",)])
    one, left = search.least_words(table, 1)
    assert (one, rows_of(left.where("length(word) < 9"))) == (["b"], [("other",), ("smo",), ("smoke",), ("the",), ("zq",)])
    said = ["A CAB", "smog", None, "", "oTHEr", "nothing", "X" * 75, "nil"]
    sentences = spark.createDataFrame([(k if k != 4 else None, s) for k, s in enumerate(said)], "sentence_id long, sentence string")
    for most in (1, 2, 512):
        found = search.flag_words(sentences.where("sentence_id is not null"), table, chain_words=most)
        assert rows_of(found.select("sentence_id")) == [(0,), (1,), (6,)]
    assert search.flag_words(sentences, table.where("word = 'the'")).count() == 1  # rows without id, too


def test_no_stretches_are_counted_where_least_words_do(spark, monkeypatch):
    monkeypatch.setattr(search, "_words_met", None)
    words = spark.range(50_000).selectExpr("concat('q', id) word").unionByName(spark.createDataFrame([("q",)], "word string"))
    sentences = spark.createDataFrame([(1, "none"), (2, "Quite")], "sentence_id long, sentence string")
    assert rows_of(search.flag_words(sentences, words).select("sentence_id")) == [(2,)]


def test_queries_of_sentences_alone_store_no_corpus(spark, monkeypatch):
    def stores(*_):
        raise AssertionError("a corpus was stored")

    monkeypatch.setattr(lexicon, "store_analysis", stores)
    monkeypatch.setattr(lexicon, "_stored", {})
    for name in SENTENCES_ALONE:
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_large_lexicon_equals_the_literal_one(spark):
    weights = {"smoke": 3, "the": -1, "дым": 2}
    rows = spark.createDataFrame([(1, "The smoke, THE Smoke"), (2, "Дым"), (3, ""), (4, "none")], "sentence_id long, sentence string").withColumn("tokens", token_array(F.col("sentence")))
    want = rows_of(rows.select("sentence_id", features.emotional_score(F.col("tokens"), weights).cast("long")))
    lexicon_ = spark.range(100_000).selectExpr("concat('x', id) word", "1 weight").unionByName(spark.createDataFrame([*weights.items(), ("the", 5)], "word string, weight int"))
    assert rows_of(features.emotional_scores(rows, lexicon_).select("sentence_id", "emotional_score")) == want == [(1, 4), (2, 2), (3, 0), (4, 0)]


def test_no_word_is_shuffled_for_a_lexicon_that_fits(spark, static):
    weights = {"smoke": 3, "the": -1, "дым": 2, "nothing": None}
    said = [(1, "The smoke, THE Smoke"), (2, "Дым"), (3, ""), (4, "none"), (None, "smoke"), (5, None), (6, "nothing"), (7, "The")]
    rows = spark.createDataFrame(said, "sentence_id long, sentence string").withColumn("tokens", token_array(F.col("sentence")))
    table = spark.createDataFrame([*weights.items(), ("the", 5), (None, 7)], "word string, weight int")
    short, long_ = (features.emotional_scores(rows, table, broadcast_words=n).select("sentence_id", "emotional_score") for n in (10, 0))
    assert rows_of(short) == rows_of(long_) == sorted([(1, 4), (2, 2), (3, 0), (4, 0), (None, 0), (5, 0), (6, 0), (7, -1)], key=repr)
    assert exchanges(short) == exchanges(long_) - 2  # neither words with their sentences nor counts by word


def test_concordance_looks_for_the_lemma_and_marks_what_was_typed(spark, texts):
    c = lexicon.run_analysis(spark, texts, "smoke").corpus
    forms = spark.createDataFrame([("Smoking", "smoke"), ("again", "smoke")], "form string, lemma string")
    shown = lambda token, **more: {r.shown for r in search.concordance(c.cross, c.words, c.tokens, c.sentences, 1, token, **more).collect()}
    assert "The acrid smoke, and smoke <mark>again</mark>!" in shown("again", lexicon=forms)
    assert "The <mark>acrid</mark> smoke, and smoke again!" not in shown("smoke") and "The acrid <mark>smoke</mark>, and <mark>smoke</mark> again!" in shown("smoke")
    assert shown("SMOKING", lexicon=forms) == {"The smoke rose.", "The acrid smoke, and smoke again!"}
    assert shown("nothing") == set()


def test_candidates_of_stored_pairs_take_wildcards(spark, texts):
    c = lexicon.run_analysis(spark, texts, "smoke").corpus
    words = analyse.lemmatise(analyse.parse_search_words(spark, "sm_ll, s%k, smoke"))
    pairs = analyse.new_pairs_only(analyse.request_pairs(c.texts, words), c.tokens)
    found = {r.sentence: sorted(r.targets) for r in analyse.candidate_sentences(c.sentences, pairs).where("text_id = 2").collect()}
    assert found == {'A sweet smell "like" honey?': ["s%k", "sm_ll"], "Smoke.": ["s%k"]}
