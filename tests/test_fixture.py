"""The hand fixture of FIXTURES.md with its expected values."""

import pytest

from corpusloom.operators import coverage, maintain, ranking, report, search
from corpusloom.sources.corpus import SCHEMAS, Corpus


@pytest.fixture(scope="module")
def c(spark):
    rows = {
        "texts": [(1, "T1", "A1", 1863, "роман"), (2, "T2", "A2", 1873, "роман"), (3, "T3", None, 1855, "рассказ")],
        "sentences": [
            (1, "Дым шёл.", 1), (2, "Пусто.", 1), (3, "Едкий дым и дым.", 1), (4, "Запах сена.", 1), (5, "Тихо.", 2),
            (6, "Сладкий запах, как мёд.", 2), (7, "Конец.", 2), (8, "Одна.", 3),
        ],
        "tokens": [(1, "дым", 1, 3), (2, "запах", 1, 1), (3, "смрад", 1, 0), (4, "запах", 2, 1), (5, "дым", 2, 0)],
        "words": [
            (1, 1, "идти", "VERB_HEAD", 1, 1), (2, 1, "едкий", "ADJ", 1, 1), (3, 1, "дым", "NOUN", 2, 1),
            (4, 2, "сено", "NOUN", 1, 1), (5, 4, "сладкий", "ADJ", 1, 2), (6, 4, "мёд", "NOUN", 1, 2),
        ],
        "cross": [(1, 1, 1, 1, 1), (2, 2, 3, 1, 1), (3, 3, 3, 1, 1), (4, 3, 3, 1, 1), (5, 4, 4, 1, 2), (6, 5, 6, 2, 4), (7, 6, 6, 2, 4)],
    }
    return Corpus(**{name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()})


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_coverage(c):
    names = ("text_id", "total_sentences", "token_sentences")
    assert got(coverage.text_coverage(c.texts, c.sentences, c.cross, c.tokens), *names, "token_sentence_percent") == [(1, 4, 3, 75.0), (2, 3, 1, 33.33), (3, 1, 0, 0.0)]
    assert got(coverage.text_coverage_joined(c.sentences, c.cross, c.tokens), *names) == [(1, 40, 3), (2, 6, 1)]
    assert got(coverage.title_coverage(c.texts, c.sentences, c.cross), "title", "total_sentences", "token_sentences", "percent") == [("T1", 20, 20, 100.0), ("T2", 6, 6, 100.0), ("T3", 1, 0, 0.0)]


def test_averages(c):
    assert [(t, round(v, 4)) for t, v in got(coverage.avg_words_per_sentence(c.cross), "text_id", "avg_words")] == [(1, 1.3333), (2, 2.0)]
    assert got(coverage.link_averages(c.cross, c.tokens), "text_id", "avg_links", "avg_links_weighted") == [(1, 1.67, 2.2), (2, 2.0, 2.0)]


def test_rankings(c):
    assert got(ranking.top_tokens(c.tokens), "text_id", "rank", "token", "total") == [(1, 1, "дым", 3), (1, 2, "запах", 1), (1, 3, "смрад", 0), (2, 1, "запах", 1), (2, 2, "дым", 0)]
    assert got(ranking.pos_totals(c.words, c.cross), "text_id", "pos", "total") == [(1, "ADJ", 1), (1, "NOUN", 5), (1, "VERB_HEAD", 1), (2, "ADJ", 1), (2, "NOUN", 1)]
    best = ranking.top_words_with_context(c.words, c.cross, c.sentences, c.tokens.where("token_id in (1, 4)"))
    assert got(best, "pos", "rank", "word", "sentence_id") == [
        ("ADJ", 1, "едкий", 3), ("ADJ", 2, "сладкий", 6), ("NOUN", 1, "дым", 3), ("NOUN", 2, "дым", 3), ("NOUN", 3, "мёд", 6), ("VERB_HEAD", 1, "идти", 1),
    ]


def test_parts_of_speech_per_token(c):
    lists = {(r.text_id, r.token): r.pos_list and [(p.part_of_speech, p.frequency, p.examples) for p in r.pos_list] for r in report.pos_per_token(c.tokens, c.words).collect()}
    assert lists[1, "дым"] == [("ADJ", 1, ["едкий"]), ("NOUN", 1, ["дым"]), ("VERB_HEAD", 1, ["идти"])]
    assert lists[1, "запах"] == [("NOUN", 1, ["сено"])] and lists[2, "запах"] == [("ADJ", 1, ["сладкий"]), ("NOUN", 1, ["мёд"])]
    assert lists[1, "смрад"] is None


def test_searches(c, spark):
    hits = search.sentences_with_tokens(c.sentences, c.cross, c.tokens)
    assert got(hits, "sentence_id") == [(1,), (3,), (4,), (6,)]
    ids = {r.sentence: r.sentence_id for r in c.sentences.collect()}
    assert sorted(ids[r.sentence] for r in search.sentences_with_context(c.sentences, hits).collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert sorted(ids[r.sentence] for r in search.sentences_with_context(c.sentences, hits, scope="global").collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    distinct = search.concordance(c.cross, c.words, c.tokens, c.sentences, 1, "дым")
    assert got(distinct.join(c.words, ["word", "pos"]), "sentence_id", "word_id") == [(1, 1), (3, 2), (3, 3)]
    assert search.concordance(c.cross, c.words, c.tokens, c.sentences, 1, "дым", distinct=False).count() == 4
    lone = spark.createDataFrame([(9, 1, 8, 3, 1), (10, 1, 8, 3, 1)], SCHEMAS["cross"])
    own = spark.createDataFrame([(1, "дым", 3, 1)], SCHEMAS["tokens"])
    assert got(search.sentences_with_author(c.sentences, lone, own, c.texts), "sentence_id", "author") == [(8, None)]
    assert got(search.sentences_with_author(c.sentences, lone, own, c.texts.where("text_id <> 3")), "sentence_id", "author") == [(8, "Unknown")]


def test_removals(c, spark):
    left = maintain.remove_occurrences(c, spark.createDataFrame([(1, 3, 3)], "token_id long, sentence_id long, word_id long"))
    assert got(left.cross, "cross_id") == [(1,), (2,), (4,), (5,), (6,), (7,)]
    assert got(left.tokens.where("token_id = 1"), "token_count") == [(2,)] and got(left.words.where("word_id = 3"), "frequency") == [(2,)]
    left = maintain.drop_texts(c, spark.createDataFrame([(2,)], "text_id long"))
    kept = [got(getattr(left, n), f"{k}_id") for n, k in (("cross", "cross"), ("words", "word"), ("sentences", "sentence"), ("tokens", "token"), ("texts", "text"))]
    assert kept == [[(1,), (2,), (3,), (4,), (5,)], [(1,), (2,), (3,), (4,)], [(1,), (2,), (3,), (4,), (8,)], [(1,), (2,), (3,)], [(1,), (3,)]]


def test_graph(c):
    nodes, edges = report.token_graph(c.texts, c.tokens)
    assert got(edges, "src", "dst") == [("text_1", "дым"), ("text_1", "запах"), ("text_2", "запах")]
    assert ("запах", "запах (1)") in got(nodes, "id", "label")
