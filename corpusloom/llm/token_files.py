"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on document ids, parallel stripes.

The text is dealt by ranges of doc_id, encoded in Arrow batches, and written in ascending order of doc_id. Every file carries
the number of its range and, per row, the tokens before it within the range, so the global start of a document needs one
sum per range and no sort of the rows that are read back.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import bounded_batches, text_of
from corpusloom.sources.shared import materialise, new_path

FILE_COLUMNS = "doc_id long, range_id int, before long, ids array<int>"
END_ID = 0
#: Bytes of the pre-tokens that a worker keeps and their ids; beyond, the half that came first goes.
KEPT_WORDS = 40 << 20
#: New pre-tokens that the library gets at once.
LINES = 20_000
#: Characters on which Python's own classes agree with the tokenizer's pattern (ASCII, Latin letters, punctuation, Greek, Cyrillic, CJK).
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-±´-¸º-»¿-ʯΑ-ΡΣ-ϿА-я‐-‧一-龥]*")
PRE_TOKEN = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
#: White space before a blank which no sign follows: such a blank may be part of a longer pre-token. All others begin one.
UNCERTAIN = re.compile(r"[\t\n\r ] (?![^\t\n\r ])")
#: Stands before the first stretch of a text, which no blank precedes; not in ``PLAIN``.
FIRST = "\0"
#: Bytes of text that are encoded at once.
PORTION = 16 << 20
#: Ids per Arrow batch that an encoder hands back to Spark.
BATCH_IDS = 1 << 20


def regrouped(lists: pa.ListArray, ends: np.ndarray) -> pa.ListArray:
    """Consecutive lists put together; ``ends`` are the bounds of the groups, from 0."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(lists.offsets)[ends]), lists.values)


class Kept:
    """Ids by string, both in Arrow arrays, so that strings are looked up many at a time and one takes few bytes more than its signs and ids."""

    def __init__(self, most: int, encode: Callable[[pa.StringArray], pa.ListArray]):
        self.most, self.encode = most, encode
        self.names, self.ids = pa.array([], type=pa.string()), pa.array([], type=pa.list_(pa.int32()))

    def __call__(self, names: pa.StringArray) -> pa.ListArray:
        """The ids of each string; those of new ones are asked for once."""
        if self.names.nbytes + self.ids.nbytes > self.most:
            self.names, self.ids = self.names[(half := len(self.names) // 2) :], self.ids[half:]
        at = pc.index_in(names, value_set=self.names)
        if at.null_count:
            missing = at.is_null()
            asked = names.filter(missing)
            new, kept = asked.unique(), len(self.names)
            self.names, self.ids = pa.concat_arrays([self.names, new]), pa.concat_arrays([self.ids, self.encode(new)])
            at = pc.replace_with_mask(at, missing, pc.add(pc.index_in(asked, value_set=new), pa.scalar(kept, pa.int32())))
        return self.ids.take(at)

    def together(self, groups: Iterator[list[str]]) -> pa.ListArray:
        """The ids of the strings of each group, one after another."""
        flat, ends = [], [0]
        for group in groups:
            flat += group
            ends.append(len(flat))
        names = pa.array(flat, type=pa.string())
        del flat
        return regrouped(self(names), np.array(ends))


class Encoder:
    """Exact encoding by the tokenizers library with the ids of recurring pre-tokens kept.

    Byte-level BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens one after another. Blanks begin
    pre-tokens, so texts are cut into stretches at blanks, and each different stretch once into pre-tokens. A text with
    characters outside ``PLAIN``, or with the string of an added token, goes to the library whole; one with an ``UNCERTAIN`` blank is cut into pre-tokens.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = int.from_bytes(self._library(["\n"])[0], "little")
        self.words = Kept(KEPT_WORDS, self._of_words)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, words: pa.StringArray) -> pa.ListArray:
        """Ids of pre-tokens: one to a line, as a line feed between them is a pre-token and an id of its own."""
        words = strings(words)
        blank = np.fromiter(map(str.isspace, words), dtype=bool, count=len(words))
        lines = [w for w in words if not w.isspace()]
        found = []
        for at in range(0, len(lines), LINES):
            part = lines[at : at + LINES]
            ids = np.frombuffer(self._library(["\n".join(part)])[0], dtype="<i4")
            feeds = np.flatnonzero(ids == self.feed)
            if len(feeds) != len(part) - 1:
                raise ValueError("line feeds don't separate pre-tokens for this tokenizer")
            ends = np.concatenate([[0], feeds - np.arange(len(feeds)), [len(ids) - len(feeds)]]).astype(np.int32)
            found.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.delete(ids, feeds))))
        found.append(id_lists(self._library([w for w in words if w.isspace()])))
        return pa.concat_arrays(found).take(pa.array(np.argsort(np.argsort(blank, kind="stable"))))

    def _of_pre_tokens(self, texts: list[str]) -> pa.ListArray:
        return self.words.together(map(PRE_TOKEN.findall, texts))

    def _of_stretches(self, stretches: pa.StringArray) -> pa.ListArray:
        coded = stretches.dictionary_encode()
        return self._of_pre_tokens([w[1:] if w[:1] == FIRST else " " + w for w in strings(coded.dictionary)]).take(coded.indices)

    def encode(self, texts: pa.StringArray) -> pa.ListArray:
        """The ids of each text."""
        signs = strings(texts)
        whole = np.array([PLAIN.fullmatch(t) is None or any(a in t for a in self.added) for t in signs], dtype=bool)
        tied = np.array([not w and UNCERTAIN.search(t) is not None for t, w in zip(signs, whole, strict=True)], dtype=bool)
        cut = pc.split_pattern(pc.binary_join_element_wise(FIRST, texts.filter(pa.array(~(whole | tied))), ""), " ")
        found = [
            regrouped(self._of_stretches(cut.flatten()), np.asarray(cut.offsets)),
            self._of_pre_tokens([signs[k] for k in np.flatnonzero(tied)]),
            id_lists([self._library([signs[k]])[0] for k in np.flatnonzero(whole)]),
        ]
        return pa.concat_arrays(found).take(pa.array(np.argsort(np.argsort(2 * whole + tied, kind="stable"))))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_lists(parts: list[bytes]) -> pa.ListArray:
    sizes = np.fromiter((len(p) // 4 for p in parts), dtype=np.int64, count=len(parts))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def strings(values: pa.StringArray) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def in_portions(items: list, weight, most: int) -> Iterator[list]:
    """Consecutive items in portions of about ``most`` in weight, one item at least."""
    portion, total = [], 0
    for x in items:
        portion.append(x)
        total += weight(x)
        if total >= most:
            yield portion
            portion, total = [], 0
    if portion:
        yield portion


def of_size(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes of text, the second column; one row at least. What the last batch took goes back before the next one."""
    held, total = [], 0
    for batch in batches:
        at = 0
        for sizes in in_portions(pc.binary_length(batch.column(1)).to_pylist(), int, most):
            held.append(batch.slice(at, len(sizes)))
            at, total = at + len(sizes), total + sum(sizes)
            if total >= most:
                yield pa.concat_batches(held)
                held, total = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield pa.concat_batches(held)


def encode_sorted(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Rows for the files, in ascending doc_id over partitions and within each (null first; equal ids by their text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        range_id, before, own = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
        for batch in of_size(batches, PORTION):
            lists = own.encode(batch.column(1))
            ends = np.asarray(lists.offsets)
            ids = np.insert(np.asarray(lists.values), ends[1:], end_id)
            ends = ends + np.arange(len(ends), dtype=np.int32)
            starts = before + ends.astype(np.int64)
            before = int(starts[-1])
            at = 0
            for sizes in in_portions(np.diff(ends).tolist(), int, BATCH_IDS):
                until = at + len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[at:until], pa.array(np.full(len(sizes), range_id, dtype=np.int32)), pa.array(starts[at:until]),
                        pa.ListArray.from_arrays(pa.array(ends[at : until + 1] - ends[at]), pa.array(ids[ends[at] : ends[until]])),
                    ],
                    names=["doc_id", "range_id", "before", "ids"],
                )
                at = until

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(encode, FILE_COLUMNS)


def write_token_files(rows: DataFrame, path: str, stripe_bytes: int = 16 << 20, stride: int = 1000) -> None:
    """ORC with a row index each ``stride`` rows, a Bloom filter on doc_id, and stripes that readers open in parallel."""
    options = {
        "orc.stripe.size": stripe_bytes, "orc.row.index.stride": stride, "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01, "orc.compress": "ZSTD",
    }
    writer = rows.write.mode("errorifexists")
    for key, value in options.items():
        writer = writer.option(key, str(value))
    writer.orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: Column | None = None) -> DataFrame:
    """The files' rows; a predicate on doc_id is pushed to file, stripe and row-group metadata and to the Bloom filters."""
    rows = spark.read.schema(FILE_COLUMNS).orc(path)
    return rows if doc_ids is None else rows.where(doc_ids)


def digests(rows: DataFrame) -> DataFrame:
    """Per document: doc_id, range_id, before, n_tokens and the CRC-32 of its ids as little-endian unsigned integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, values = np.asarray(lists.offsets), memoryview(np.ascontiguousarray(np.asarray(lists.values), dtype="<i4")).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, type=pa.int64())], names=["doc_id", "range_id", "before", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "range_id", "before", "ids").mapInArrow(digest, "doc_id long, range_id int, before long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``: all tokens of earlier documents. One row per range is summed, read from the ranges' last rows."""
    totals = rows.groupBy("range_id").agg(F.sum("n_tokens").alias("range_tokens"))
    earlier = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("range_id", F.coalesce(F.sum("range_tokens").over(earlier), F.lit(0)).alias("base"))
    return rows.join(bases, "range_id").withColumn("start", F.col("base") + F.col("before")).drop("base")


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty, so every row gets at least the end id; rows with equal ids stand in the order of their texts, repeated ones side by
    side. A text of any length is one row of ids; an empty table gives no rows; further columns, whatever their names, are ignored."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark, "token-orc")
    write_token_files(encode_sorted(docs, public_tokenizers.path("byte_bpe_50k.json")), path)
    rows = materialise(digests(read_token_files(spark, path)), "token-digests")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
