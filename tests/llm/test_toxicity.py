import itertools
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import toxicity

#: Large enough to learn from: about 3,000 labelled rows outside the held-out quarter (at sf0.01, 300).
SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scores(spark):
    return {r.doc_id: r for r in toxicity.op2_toxicity(spark, SF).collect()}


def test_held_out_quarter_is_told_apart(spark, scores):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None}
    toxic = [scores[d].score for d, t in labels.items() if t and d in scores and scores[d].held_out]
    clean = [scores[d].score for d, t in labels.items() if not t and d in scores and scores[d].held_out]
    assert toxic and clean
    won = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert won > 0.95


def test_every_document_is_scored_once(spark, scores):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert toxicity.op2_toxicity(spark, SF).count() == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scores.values())


def test_decoder_restores_disguised_words(make_docs):
    docs = make_docs([(k, "they hate stupid people and a hateful idiot is stupid") for k in range(50)])
    decoder = toxicity.Decoder(toxicity.trigram_model(toxicity.trigram_counts(docs)))
    assert [decoder.restore(w) for w in ("h4te", "stup1d", "s.t.u.p.i.d", "haaaate", "1d10t")] == ["hate", "stupid", "stupid", "hate", "idiot"]


def test_nulls_repeats_clashing_columns_and_one_class(spark, make_docs):
    rows = [(1, "you vile creature"), (1, "you vile creature"), (2, None), (None, ""), (3, "x " * 50_000), (4, "a pleasant day")]
    docs = make_docs(rows).withColumn("score", F.lit("s")).withColumn("toxic", F.lit(None).cast("int"))
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    found = toxicity.scored(docs, labels)
    assert found.columns == [*docs.columns, "_tox_score"]
    out = found.collect()
    assert len(out) == len(rows) and all(0 <= r._tox_score <= 1 for r in out)
    assert len({r._tox_score for r in out if r.doc_id == 1}) == 1
    assert len({r._tox_score for r in out if not r.text}) == 1
    unlabelled = toxicity.scored(docs, labels.where("false")).collect()
    assert {r._tox_score for r in unlabelled} == {0.5}
    assert toxicity.scored(docs.where("false"), labels).count() == 0


def test_disguises_at_any_place_reach_the_decoder(make_docs):
    docs = make_docs([(k, "an ass and a whore and a bitch and a girl hate the stupid idiot , the girl is an idiot ! the lass and the ass pass the class") for k in range(50)])
    decoder = toxicity.Decoder(toxicity.trigram_model(toxicity.trigram_counts(docs)))
    read = toxicity.features_of(decoder)
    words = {"a$$": "ass", "a55": "ass", "idio7": "idiot", "whor3": "whore", "!diot": "idiot", "8itch": "bitch", "9irl": "girl", "i.d.i.o.t": "idiot", "i.d.i.o.t!": "idiot", "(i-d-i-o-t),": "idiot", "idiot!": "idiot", "a$$,": "ass"}
    assert {w: read(w)[0] for w in words} == words
    assert read("2019") == ("2019",) and read("stupid.")[0] == "stupid"
    for text in ("you i d i o t, go", "i d i o t!", "(i d i o t) and", "an i d i o t"):
        assert "idiot" in toxicity.words_of(text, decoder)


def test_viterbi_finds_the_best_of_all_readings(make_docs):
    docs = make_docs([(k, "an ass and a whore hate the stupid idiot , the lass is a bass ! дурак и дубина всё знает") for k in range(20)])
    model = toxicity.trigram_model(toxicity.trigram_counts(docs))
    decoder = toxicity.Decoder(model)
    code = lambda c: int(toxicity.ALPHABET[ord(c)])

    def cost(letters):
        total, x, y = 0.0, 0, 0
        for c in letters:
            total += float(model[x, y, code(c)])
            x, y = y, code(c)
        return total

    for word in ("a55", "h4t3", "1d10t", "s.t.u.p.1.d", "iiidiot", "wh0r3!", "$tup|d", "дур@к", "ду6ин@", "idi\u043et", "l\u0430ss", "a$$$"):
        readings = {}
        for path in itertools.product(*decoder.lattice(word)):
            letters = "".join(p[1] for p in path)
            readings[letters] = max(readings.get(letters, -math.inf), cost(letters + " ") - sum(p[0] for p in path))
        best = max(readings.values())
        assert decoder.restore(word) in {r.strip() for r, v in readings.items() if abs(v - best) < 1e-3}, word
    assert [decoder.restore(w) for w in ("дур@к", "ду6ин@", "idi\u043et", "l\u0430ss")] == ["дурак", "дубина", "idiot", "lass"]
