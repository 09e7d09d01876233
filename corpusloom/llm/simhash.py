"""SimHash near-dedup by an index over byte positions with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most four bits share at least four of them, so
four is the guaranteed count. Lists of single bytes would hold every 256th document, so the inverted index has lists of four positional
bytes, under every set of four positions (70 keys): two that reach the count meet, and no others do. The shared bytes of
each pair that meets are tallied; a pair that reaches the count is looked at in the list of its first four shared positions alone, and verified on all
64 bits.

Equal fingerprints are one class from the start. In a long list, links are found by growing components in blocks of the other bits, of
which near copies share one: a member looks only at those that no component holds yet, so a large group of near copies costs its size,
not its square, and yields a tree of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import bounded_batches, components, text_of
from corpusloom.sources.shared import materialise

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Shingles whose bits are counted at once.
PIECE = 1 << 16
#: Lists up to this size are compared by shifts over many lists together; longer ones one by one.
SHORT = 12
#: Rows of sorted lists that a worker takes at once, and length from which a list is cut into blocks.
LIST_ROWS, LONG = 200_000, 256


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all shingles of the lower-cased words (A-Z only), repeats included; none: zero."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    h, text = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        values = [h(text, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = [0, *ends[: len(words) - shingle].tolist()]
        values = [h(text[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), PIECE):
        block = np.array(values[at : at + PIECE], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp) per row: fingerprint as a signed long and a hash of the text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(raw.as_py()) for raw in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(values, dtype=np.uint64).view(np.int64))], names=["doc_id", "th", "fp"])

    bounded_batches(docs.sparkSession)
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def postings(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(key, fp): each fingerprint under its bytes at every set of 8 - distance positions."""
    sets = list(combinations(range(8), 8 - distance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype(np.int64)
            for at in range(0, len(fp), PIECE):
                part = fp[at : at + PIECE]
                octets = part.view(np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.uint64)
                for number, chosen in enumerate(sets):
                    key = np.full(len(part), number, dtype=np.uint64)
                    for position in chosen:
                        key = (key << np.uint64(8)) | octets[:, position]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part)], names=["key", "fp"])

    if not 4 <= distance <= 7:
        raise ValueError("four to seven differing bits: keys of at most four bytes fit beside the number of their set")
    return fps.select("fp").mapInArrow(run, "key long, fp long")


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The positions of each pair's shared bytes, as bits of a number."""
    shared = (a ^ b).view(np.uint8).reshape(-1, 8) == 0
    return np.packbits(shared, axis=1, bitorder="little")[:, 0]


def first_sets(distance: int = DISTANCE) -> np.ndarray:
    """For each set of shared positions the number of the first key that it holds, or -1 below the guaranteed count."""
    sets = [sum(1 << p for p in chosen) for chosen in combinations(range(8), 8 - distance)]
    return np.array([next((n for n, s in enumerate(sets) if s & shared == s), -1) for shared in range(256)])


def _grown(members: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links (a, b) that span the components of these members; every pair within the distance is connected by them."""
    left, right, rest = [], [], members
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= distance
            if near.any():
                hit = rest[near]
                rest = rest[~near]
                left += [root] * len(hit)
                right += hit.tolist()
                front += list(hit)
    return left, right


def _linked_in(members: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """The same for a list of any length. A long one is cut by each of distance + 1 blocks of its bits in turn: of two within the distance
    one block is equal, so no link is lost, and only members that share a block are compared."""
    if len(members) < LONG:
        return _grown(members, distance)
    left, right = [], []
    varying = np.bitwise_or.reduce(members ^ members[0])
    bits = [k for k in range(64) if int(varying) >> k & 1]  # what all share doesn't tell any apart
    edges = np.linspace(0, len(bits), distance + 2).astype(int).tolist()
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        mask = np.uint64(sum(1 << k for k in bits[low:high]))
        block = members & mask
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        for part in np.split(members[order], cuts):
            if len(part) > 1:
                a, b = _grown(part, distance)
                left += a
                right += b
    return left, right


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, fp) of whole lists of a partition sorted by key, some LIST_ROWS at a time."""
    parts, size = [], 0
    for batch in batches:
        parts.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        size += batch.num_rows
        if size >= LIST_ROWS:
            key, fp = (np.concatenate(c) for c in zip(*parts, strict=True))
            before = np.flatnonzero(key != key[-1])
            cut = before[-1] + 1 if len(before) else 0
            if cut:
                yield key[:cut], fp[:cut].view(np.uint64)
            parts, size = [(key[cut:], fp[cut:])], 0
    if parts:
        key, fp = (np.concatenate(c) for c in zip(*parts, strict=True))
        yield key, fp.view(np.uint64)


def links(posted: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): verified links between fingerprints that connect all that lie within the distance."""
    first = first_sets(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _lists(b for b in batches if b.num_rows):
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([begin, [len(key)]]))
            short = np.repeat(size <= SHORT, size)
            left, right = [], []
            for step in range(1, min(SHORT, len(key))):
                met = (key[step:] == key[:-step]) & short[step:]
                if not met.any():
                    break
                a, b = fp[:-step][met], fp[step:][met]
                here = first[tally(a, b)] == (key[step:][met] >> (8 * (8 - distance)))  # counted, and in no list before
                near = here & (np.bitwise_count(a ^ b) <= distance)
                left.append(a[near])
                right.append(b[near])
            for at, n in zip(begin[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
                a, b = _linked_in(np.unique(fp[at : at + n]), distance)
                left.append(np.array(a, dtype=np.uint64))
                right.append(np.array(b, dtype=np.uint64))
            if left and sum(map(len, left)):
                pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

    lists = posted.repartition("key").sortWithinPartitions("key")
    return lists.mapInArrow(run, "a long, b long").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id): one row per distinct fingerprint; the smallest doc_id that its links reach (null: ids are all null)."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    label = components(links(postings(distinct, distance), distance), "simhash")
    named = distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    named = materialise(named, "simhash-named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return materialise(named.select("fp", "root").join(lowest, "root").select("fp", "root", "component_id"), "simhash-roots")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, th, fp, root, component_id.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows are documents of their own. Null ids
    take part but never name a component. Texts of any length are read whole; empty tables give no rows; further columns are ignored.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "simhash-prints")
    return prints.join(classes(prints, distance), "fp").select("doc_id", "th", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents with one row of each component: smallest doc_id (null last), then smallest hash of the text."""
    found = near_duplicates(docs, distance)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")).alias("best")
    keep = found.groupBy("root").agg(best).select(F.col("best.doc_id").alias("_keep_id"), F.col("best.th").alias("_keep_th"))
    rows = docs.withColumn("_keep_row_id", F.col("doc_id").cast("long")).withColumn("_keep_row_th", F.xxhash64(text_of()))
    stay = rows.join(materialise(keep, "simhash-keep"), F.col("_keep_row_id").eqNullSafe(F.col("_keep_id")) & (F.col("_keep_row_th") == F.col("_keep_th")))
    return stay.dropDuplicates(["_keep_row_id", "_keep_row_th"]).select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, repeated rows and texts without words among them; only columns whose names begin with _keep_ clash."""
    return one_of_each(docs)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
