"""Quality: held-out accuracy, and each score computed again in plain Python."""

import math
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import quality

DATA = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string, lang string, quality string", "doc_id long, quality int, toxic int, text string"


def vector(text):
    """The places and weights of a text, from the definition."""
    mask = (1 << 64) - 1
    grams, tokens = Counter(), re.findall(r"\w+|[^\w\s]+", text)
    pair, shapes = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

    def shape(t):
        if t.isdigit():
            return "9"
        if not (t[0].isalnum() or t[0] == "_"):
            return t
        return "A" if t.isupper() and len(t) > 1 else "a" if t.islower() else "Aa" if t.istitle() else "aA"

    w, s = [xxhash.xxh64_intdigest(t.lower()) for t in tokens], [xxhash.xxh64_intdigest("\0" + shape(t)) for t in tokens]
    for g in [*w, *(a * pair + b for a, b in zip(w, w[1:])), *(a * shapes for a in s), *(((a * pair + b) & mask) * shapes for a, b in zip(s, s[1:]))]:
        g &= mask
        g = ((g ^ (g >> 31)) * 0x7FB5D329728EA185) & mask
        grams[g >> 46] += 1
    return {p: math.sqrt(c / len(tokens)) for p, c in sorted(grams.items())}


def learned(rows):
    """FTRL-Proximal by the book: rows (hash, target, vector) over the shards, averaged, twice."""
    z, n = {}, {}
    bias = quality.PLACES

    def weight(z, n, p):
        short = 0.0 if p == bias else quality.L1
        a, b = z.get(p, 0.0), n.get(p, 0.0)
        return 0.0 if abs(a) <= short else -(a - math.copysign(short, a)) / ((quality.BETA + math.sqrt(b)) / quality.ALPHA + (0.0 if p == bias else quality.L2))

    for _ in range(quality.ROUNDS):
        states = []
        for shard in range(quality.SHARDS):
            mine = sorted((r for r in rows if r[0] % quality.SHARDS == shard), key=lambda r: r[0])
            if not mine:
                continue
            zs, ns = dict(z), dict(n)
            for _ in range(quality.PASSES):
                for _, target, v in mine:
                    v = v | {bias: 1.0}
                    w = {p: weight(zs, ns, p) for p in v}
                    error = 1 / (1 + math.exp(-max(-30, min(30, sum(w[p] * x for p, x in v.items()))))) - target
                    for p, x in v.items():
                        g, b = error * x, ns.get(p, 0.0)
                        zs[p] = zs.get(p, 0.0) + g - (math.sqrt(b + g * g) - math.sqrt(b)) / quality.ALPHA * w[p]
                        ns[p] = b + g * g
            states.append((zs, ns))
        z, n = ({p: sum(s[k].get(p, 0.0) for s in states) / len(states) for s0 in states for p in s0[k]} for k in range(2))
    return lambda v: 1 / (1 + math.exp(-max(-30, min(30, sum(weight(z, n, p) * x for p, x in (v | {bias: 1.0}).items())))))


@pytest.fixture(scope="module")
def small(spark):
    texts = [f"Good words number {k} stand here, and more of them." for k in range(60)] + [f"BAD!! junk{k} *** $$$ {k} BUY!!" for k in range(40)]
    rows = [(k, t, "en", "q") for k, t in enumerate(texts)]
    rows += [(200, None, None, None), (201, "", "en", "q"), (202, " \n", "en", "q"), (None, "Good words", "en", "q"), (5, "another text of five", "en", "q"), (5, "another text of five", "en", "q"), (203, "word BAD!! " * 100_000, "en", "q")]
    labels = [(k, int(k < 60), 0, "t") for k in range(100)] + [(3, 0, 0, "t"), (None, 1, 0, "t"), (7, None, 0, "t"), (999, 1, 0, "t"), (201, 0, 0, "t")]
    return rows, labels, spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)


def test_scores_equal_plain_python(spark, small):
    rows, labels, docs, marks = small
    known = {}
    for i, q, _, _ in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            known[i] = min(q, known.get(i, 1))
    hashes = {r.i: r.h for r in spark.createDataFrame([(i,) for i in known], "i long").select("i", F.xxhash64("i").alias("h")).collect()}
    teach = [(hashes[i], q, vector(min(t or "" for j, t, *_ in rows if j == i))) for i, q in known.items() if any(r[0] == i for r in rows)]
    score = learned(teach)
    found = quality.scored(docs, marks)
    assert found.columns == [*docs.columns, "_quality_score"]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "", r._quality_score) for r in found.collect()), key=lambda r: r[:3])
    want = sorted(((i is None, i or 0, t or "", score(vector(t or ""))) for i, t, *_ in rows), key=lambda r: r[:3])
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, want)) < 1e-9


def test_no_labels_no_rows(spark, small):
    _, _, docs, marks = small
    assert {r._quality_score for r in quality.scored(docs, marks.limit(0)).collect()} == {0.5}
    assert quality.scored(docs.where("doc_id = -1"), marks).count() == 0


def test_the_sample_is_bounded_by_ids(spark, small):
    _, _, docs, marks = small
    rows = quality.teaching_rows(docs.unionByName(docs), marks, 10)
    assert rows.count() == 10 and rows.select("at").distinct().count() == 10


def test_held_out_quarter(spark):
    rows = quality.op12_quality(spark, DATA)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = rows.toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(rows.doc_id, rows.held_out))
    assert ((rows.score >= 0.7).astype(int) == rows.predicted).all()
    both = rows[rows.held_out].merge(spark.read.parquet(f"{DATA}/labels.parquet").toPandas(), on="doc_id")
    good, bad = both[both.quality == 1].score, both[both.quality == 0].score
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.95
    assert (good >= 0.7).mean() > 0.95
