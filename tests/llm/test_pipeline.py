"""Every stage of the pipeline on its own input, and the whole of it, against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_dedup import WORD, brute_components, brute_fingerprint

import corpus_pipeline
from corpusloom.llm import mixing, sentencepiece_fst, simhash, substrings, toxicity

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def one_of_each(rows):
    """rows: (doc_id, text, ...); of each component the row of the smallest doc_id stays."""
    label = brute_components([brute_fingerprint(r[1]) for r in rows], [r[0] for r in rows])
    return [r for r, low in zip(rows, label) if r[0] == low]


def without_repeats(rows, window=35):
    texts = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(ws[i : i + window]) for ws in texts for i in range(len(ws) - window + 1))
    out = []
    for r, ws in zip(rows, texts):
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone.update(range(i, i + window))
        text = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((r[0], text, *r[2:4], len(text)) if gone else r)
    return out


def mixed(rows):
    """Each row as often as the mix takes it, with the level of the targets found by trying the sources one after another."""
    size = lambda r: len(WORD.findall(r[1] or ""))
    hashed = lambda r: int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(map(size, by_source[s])) for s in order}
    target, left, open_ = {}, Fraction(3, 2) * sum(total.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * total[s]}
        for s in full or open_:
            target[s] = 2 * total[s] if full else weight[s] * level
        left -= sum(2 * total[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for s in order:
        rounds = int(target[s] // total[s]) if total[s] else 0
        budget, used, closed = target[s] - rounds * total[s], 0, False
        groups = defaultdict(list)
        for r in by_source[s]:
            groups[hashed(r)].append(r)
        for h in sorted(groups):
            used += sum(map(size, groups[h]))
            closed = closed or used > budget or not total[s]
            for r in groups[h]:
                out += [r] * (rounds + (not closed))
    return out


def encoded(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = Counter()
    for r in rows:
        ids = model.encode(r[1] or "")
        n_bytes = sum(model.is_byte(i) for i in ids)
        out[r[0], len(ids), n_bytes, zlib.crc32(np.array(ids, dtype="<i4").tobytes()), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, make_docs, mixed_rows):
    """Odd rows with unique ids and several sources, and columns with names that the operators use themselves."""
    rows = [(5_000 + k, r[1], ("b", "a", None, "Z")[k % 4]) for k, r in enumerate(mixed_rows)]
    clash = {c: F.lit(1) for c in ("fp", "root", "size", "target", "threshold", "score", "key", "ids", "component_id")}
    return make_docs(rows), make_docs(rows).withColumns(clash)


def test_toxicity_stage_rejects_by_score_alone(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = toxicity.scored(documents, labels)
    kept = toxicity.stage(spark, documents, SF)
    assert kept.columns == documents.columns
    assert rows_of(kept) == rows_of(scores.where("_tox_score < 0.3").select(*documents.columns))
    assert 0 < kept.count() <= documents.count()
    assert toxicity.stage(spark, documents.limit(0), SF).count() == 0


@pytest.mark.parametrize("stage, brute", [(simhash.stage, one_of_each), (substrings.stage, without_repeats), (mixing.stage, mixed)])
def test_stages_that_choose_and_cut(spark, documents, odd, stage, brute):
    plain, clashing = odd
    for docs in (documents, plain):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        assert rows_of(got) == Counter(brute([tuple(r) for r in docs.collect()]))
    assert rows_of(stage(spark, clashing, SF).select(*plain.columns)) == rows_of(stage(spark, plain, SF))
    assert stage(spark, plain.limit(0), SF).count() == 0


def test_sentencepiece_stage(spark, documents, odd):
    for docs in (documents, odd[0]):
        assert rows_of(sentencepiece_fst.stage(spark, docs, SF)) == encoded(map(tuple, docs.collect()))
    assert sentencepiece_fst.stage(spark, documents.limit(0), SF).count() == 0


def test_the_whole_pipeline(spark, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mixing", "sentencepiece"]
    scores = toxicity.scored(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [tuple(r) for r in scores.where("_tox_score < 0.3").select(*documents.columns).collect()]
    assert rows_of(corpus_pipeline.run(spark, SF)) == encoded(mixed(without_repeats(one_of_each(rows))))
