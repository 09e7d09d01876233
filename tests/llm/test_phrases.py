"""Collocations against brute force on words, and against their SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from corpusloom.llm import phrases

SCHEMA = "lang string, text string, score string, phrase int, row string"


def brute(rows, longest=3, least=10, share=50, best=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                counts.update((lang, *w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    candidates = {k: a for k, a in counts.items() if len(k) > 2 and a >= least}
    for (lang, *w), a in candidates.items():
        score, k, left, right = min((10**6 * a * a // (counts[lang, *w[:k]] * counts[lang, *w[k:]]), k, counts[lang, *w[:k]], counts[lang, *w[k:]]) for k in range(1, len(w)))
        inside = any(
            m == lang and len(v) > len(w) and 100 * b >= share * a and any(list(v[i : i + len(w)]) == w for i in range(len(v) - len(w) + 1)) for (m, *v), b in candidates.items()
        )
        if not inside:
            out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    found, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= best:
            found.append((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["the", "The", "of", "new", "york", "city", "straße", "STRASSE", "É", "é", "x y", "…", "a", "b\x00", "end."]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "\x0b", "! "]) for _ in range(n))
    out = [(rng.choice(["en", "en", "de", None, ""]), say(rng.randint(0, 80))) for _ in range(120)]
    out += [("en", "new york city hall")] * 30 + [("en", None), (None, ""), ("fr", " \t,;."), ("fr", "mot " * 40), ("en", "new york city " * 4000), ("en", "q r s t " * 12)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1, "r") for a, b in rows], SCHEMA).repartition(5)


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_collocations_equal_brute_force(spark, rows):
    assert found(phrases.collocations(table(spark, rows))) == brute(rows)


def test_longer_phrases_and_other_bounds(spark, rows):
    assert found(phrases.collocations(table(spark, rows), longest=5, least=4, share=80, best=20)) == brute(rows, 5, 4, 80, 20)
    assert found(phrases.collocations(table(spark, rows), longest=2, best=3)) == brute(rows, 2, best=3)


@pytest.mark.parametrize("bits", [(4, 28), (9, 20), (64, 1)])
def test_collisions_are_told_apart_by_text(spark, rows, bits):
    """Narrow fingerprints collide all the time; what is counted in the end are words."""
    assert found(phrases.collocations(table(spark, rows), least=6, bits=bits)) == brute(rows, least=6)


def test_blocks_of_any_size(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 500)
    parts = [[np.array(c) for c in zip(*some)] for some in ([(1, 9, 5, 2, 7, 0), (1, 9, 5, 3, 8, 1), (2, 9, 5, 1, 8, 1)], [(1, 9, 6, 1, 7, 0), (1, 3, 5, 1, 1, 1), (1, 9, 5, 4, 9, 9)])]
    added = phrases._added([np.concatenate(c) for c in zip(*parts)])
    assert sorted(zip(*(c.tolist() for c in added))) == [(1, 3, 5, 1, 1, 1), (1, 9, 5, 9, 7, 0), (1, 9, 6, 1, 7, 0), (2, 9, 5, 1, 8, 1)]
    few = table(spark, rows).selectExpr("xxhash64(text) row", "coalesce(lang, 'und')", "coalesce(text, '')").toArrow()
    assert sum(len(b.rows) for b in phrases._blocks(iter(few.to_batches()), (64, 64))) == len(rows)


def test_bitmap_has_each_place_and_no_other(spark):
    bits = phrases.bitmap_of(spark.createDataFrame([(0,), (5,), (5,), (32_768,), ((1 << 17) - 1,)], "place long"), 1 << 17)
    assert bits.nonzero()[0].tolist() == [0, 4096, (1 << 14) - 1] and (bits[0], bits[4096], bits[-1]) == (33, 1, 128)


def test_no_frequent_pair_misses_the_bitmap(spark, rows):
    texts = table(spark, rows).selectExpr("xxhash64(text) row", "coalesce(lang, 'und') lang", "coalesce(text, '') text")
    places = {r.place for r in phrases.frequent_places(texts, (1, 2), None, 10, 7).collect()}
    block = phrases.Block([(0, "en", phrases.hashed(b"new york city".split())), (0, "de", phrases.hashed(b"mot mot".split()))])
    found = [int(phrases._place(*phrases._split(block.fingerprints(2, 0)[at : at + 1], 7), phrases.BITMAP)[0]) in places for at in (0, 1, 4)]
    assert found == [True, True, False]


def test_places_that_do_not_fit_are_counted_by_words(spark, rows, monkeypatch):
    """A pointer that leads nowhere, as in texts of more than 2**24 words."""
    monkeypatch.setattr(phrases, "_gathered", lambda *a, f=phrases._gathered: [c if k < 5 else np.full_like(c, (1 << 24) - 1) for k, c in enumerate(f(*a))])
    few = rows[:40] + [("en", "new york city hall")] * 12
    assert found(phrases.collocations(table(spark, few))) == brute(few)


def test_equal_words_have_equal_fingerprints_wherever_they_stand():
    block = phrases.Block([(1, "en", phrases.hashed([b"a", b"b", phrases.BREAK, b"a", b"b"])), (2, "de", phrases.hashed([b"a", b"b"]))])
    for size, places in ((1, (0, 3)), (2, (0, 3))):
        for which in range(2):
            prints = block.fingerprints(size, which)
            assert prints[places[0]] == prints[places[1]] != prints[6]
    assert block.whole(2).tolist() == [0, 3, 6]


def test_empty_table_and_words_only_once(spark):
    assert found(phrases.collocations(table(spark, [("en", "one two three")]).where("lang = 'xx'"))) == []
    assert found(phrases.collocations(table(spark, [("en", "one two three"), (None, None)]))) == []


def test_large_counts_stay_exact(spark):
    """Products beyond 64 bits: the score of one phrase among counts of the order of 10**9."""
    a, l, r = 2_000_000_011, 3_000_000_019, 4_000_000_007
    row = spark.sql(f"select cast(cast(1000000 as decimal(7,0)) * cast({a}L as decimal(15,0)) * cast({a}L as decimal(15,0)) div (cast({l}L as decimal(18,0)) * cast({r}L as decimal(18,0))) as long) s").first()
    assert row.s == 10**6 * a * a // (l * r)


def test_query_against_its_sql(spark):
    data = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
        wanted = sorted(db.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({phrases.OP11_SQL})").fetchall())
    assert found(phrases.op11_phrases(spark, data)) == wanted and wanted
