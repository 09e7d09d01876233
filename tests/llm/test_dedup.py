"""Substring dedup and SimHash against brute force, with the odd cases of the contracts."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import simhash, substrings
from corpusloom.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(rows, window=35):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(ws[i : i + window]) for ws in texts for i in range(len(ws) - window + 1))
    out = []
    for (doc_id, _), ws in zip(rows, texts):
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((doc_id, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def from_operator(docs, window=35):
    rows = substrings.without_repeats(docs, window).collect()
    return Counter((r.doc_id, r._sub_words, r._sub_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows)


def test_substrings_equal_brute_force(make_docs, mixed_rows):
    assert from_operator(make_docs(mixed_rows)) == brute_substrings(mixed_rows)


def test_substrings_other_windows(make_docs, mixed_rows):
    for window in (1, 2, 6, 13):
        assert from_operator(make_docs(mixed_rows), window) == brute_substrings(mixed_rows, window)


def test_substrings_small_blocks_and_empty(make_docs, mixed_rows, monkeypatch):
    assert from_operator(make_docs([])) == Counter()
    monkeypatch.setattr(substrings, "BLOCK_WORDS", 300)
    docs = make_docs(mixed_rows).repartition(7).withColumns({c: F.lit(1) for c in ("key", "id", "th", "pos", "runs")})
    assert from_operator(docs) == brute_substrings(mixed_rows)


def test_substrings_of_many_equal_rows(make_docs, monkeypatch):
    """Equal rows share one list of runs, however many they are; so do rows of one id. Another text shares only part of it."""
    text = " ".join(f"w{k % 97}x{k}" for k in range(400))
    rows = [(None, text)] * 3000 + [(7, text + " end")] * 2000 + [(8, "other words " + " ".join(text.split()[100:180]) + " and more")] + [(None, "short text")] * 50
    monkeypatch.setattr(substrings, "BLOCK_WORDS", 50_000)
    docs = make_docs(rows).repartition(8)
    runs = substrings.repeated_windows(substrings.keyed(docs)).select(F.max(F.size("_sub_runs")), F.count("*")).first()
    assert runs[0] <= 400 and runs[1] == 3
    assert from_operator(docs) == brute_substrings(rows)


def test_a_text_of_a_million_words(make_docs):
    words = [f"v{k * k % 1_000_003}" for k in range(1_000_000)]
    rows = [(1, " ".join(words)), (2, "a b " + " ".join(words[500_000:500_050]) + " c"), (3, None)]
    assert from_operator(make_docs(rows)) == brute_substrings(rows)
    prints = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(make_docs([(1, " ".join(words)), (2, " ".join(words)), (3, "one")])).collect()}
    assert prints[1] == prints[2] and prints[1][1] == 1 and prints[3][1] == 3


def test_substrings_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert from_operator(docs) == brute_substrings(rows)


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    left, label = set(range(len(fps))), {}
    array = np.array(fps, dtype=np.uint64)
    while left:
        group, front = set(), [left.pop()]
        while front:
            k = front.pop()
            group.add(k)
            near = set(np.flatnonzero(np.bitwise_count(array ^ array[k]) <= 4).tolist()) & left
            left -= near
            front += near
        low = min((ids[k] for k in group if ids[k] is not None), default=None)
        label |= dict.fromkeys(group, low)
    return [label[k] for k in range(len(fps))]


def check_simhash(docs, rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    want = Counter(zip(ids, fps, brute_components(fps, ids)))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


def test_simhash_equals_brute_force(make_docs, mixed_rows):
    check_simhash(make_docs(mixed_rows), mixed_rows)


def test_simhash_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_simhash(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_simhash_large_postings(spark):
    rng = np.random.default_rng(3)
    centre = np.uint64(0x0123456789ABCDEF)
    fps = [centre]
    for _ in range(600):
        x = fps[rng.integers(len(fps))]
        for b in rng.integers(0, 64, size=3):
            x = x ^ (np.uint64(1) << np.uint64(b))
        fps.append(x)
    fps = np.unique(np.array(fps + list(rng.integers(0, 2**63, size=300).astype(np.uint64)), dtype=np.uint64))
    frame = spark.createDataFrame([(int(x.astype(np.int64)),) for x in fps], "fp long")
    got = components(simhash.links(simhash.postings(frame)))
    label = {r.node: r.component for r in got.collect()}
    signed = [int(x.astype(np.int64)) for x in fps]
    want = brute_components(fps, signed)
    assert [label.get(s, s) for s in signed] == want


def test_one_of_each_keeps_one_row(make_docs, mixed_rows):
    docs = make_docs(mixed_rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    found = {(r.doc_id, r.th): r.root for r in simhash.near_duplicates(docs).collect()}
    assert kept.count() == len(set(found.values()))
    assert {r.doc_id for r in kept.collect()} >= {r.component_id for r in simhash.near_duplicates(docs).collect() if r.component_id is not None}
    assert simhash.one_of_each(make_docs([])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (5000, 5000), (None, 3)], "a long, b long")
    label = {r.node: r.component for r in components(edges).collect()}
    assert {label[k] for k in range(301)} == {0} and label[1001] == 1000 and label[5000] == 5000


def test_tallies_and_first_lists():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    shared = simhash.tally(a, b)
    for x, y, s in zip(a.tolist(), b.tolist(), shared.tolist()):
        assert s == sum(1 << p for p in range(8) if x >> 8 * p & 255 == y >> 8 * p & 255)
    first = simhash.first_sets()
    assert first[0] == first[0b111] == -1 and first[0b1111] == 0 and first[255] == 0 and first[0b11110000] == 69


def test_long_lists_lose_no_link():
    rng = np.random.default_rng(2)
    members = np.unique(np.concatenate([rng.integers(0, 1 << 32, 600, dtype=np.uint64), np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 32, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 32, 300, dtype=np.uint64))]))
    assert len(members) > simhash.LONG

    def classes(left, right):
        root = {m: m for m in members.tolist()}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for x, y in zip(left, right):
            root[find(int(x))] = find(int(y))
        groups = {}
        for m in root:
            groups.setdefault(find(m), set()).add(m)
        return sorted(map(sorted, groups.values()))

    near = np.bitwise_count(members[:, None] ^ members) <= 4
    assert classes(*simhash._linked_in(members, 4)) == classes(members[np.nonzero(near)[0]], members[np.nonzero(near)[1]])
