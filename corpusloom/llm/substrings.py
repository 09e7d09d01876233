"""Substring dedup by level-wise doubling over content-chosen anchors.

A window of W words is represented by one anchor: of the word sequences of length L = ceil(W / 4) that start in its first
W - 2L + 1 places, the one with the smallest hash, the leftmost of equals. Equal windows have equal anchors at equal
offsets, so a window can only repeat if its anchor does at length L, and at 2L, which still lies inside the window. Level by
level, anchors that stand alone at one length are dropped and the others extended to twice that length. What survives is extended once more, to
the stretch of all windows that share the anchor: equal stretches settle their windows at once, and where stretches of one anchor
differ (at the ends of passages), their windows are compared one by one, at full length and by 128 bits.

At each level a task first settles what repeats among its own rows and ships each such sequence once, as a marker. A sequence that
fills a third of the corpus so reaches its reducer at most once per task, and no key has to be split or capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import bounded_batches, text_of, tidied, with_fields

WINDOW = 35
#: Words of a task, and rows of a shuffle partition, that are looked at together before rows are shipped.
BLOCK_WORDS, BLOCK_ROWS = 1_500_000, 200_000
KEPT_WORDS = 200_000
LONE, SETTLED, MARKER = 0, 1, 2
#: A row stands for the ``cnt`` windows from word ``pos`` on; chk and seg are further hashes of it.
ROW = "key long, chk long, seg long, id long, th int, pos int, cnt short, kind byte"
RUN = "id long, th int, pos int, cnt short, kind byte"
RUN_NAMES = ["id", "th", "pos", "cnt", "kind"]
_KINDS = {"key": np.uint64, "chk": np.uint64, "seg": np.uint64, "id": np.int64, "th": np.int32, "pos": np.int32, "cnt": np.int16, "kind": np.int8}
#: Odd multipliers of the two window hashes, and of the mixing step.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = _WordHash()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the bases and of their inverses modulo 2**64, grown as texts ask for them."""

    def __init__(self):
        self.up = [np.ones(1, dtype=np.uint64) for _ in _BASES]
        self.down = [np.ones(1, dtype=np.uint64) for _ in _BASES]

    def get(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up[which]) < n:
            size = max(n, 2 * len(self.up[which]))
            for table, base in ((self.up, _BASES[which]), (self.down, pow(_BASES[which], -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                table[which] = np.cumprod(steps, dtype=np.uint64)
        return self.up[which][:n], self.down[which][:n]


_powers = _Powers()


class _Text:
    """Hashes of one text's words and of its word sequences."""

    def __init__(self, raw: bytes):
        words = raw.split()
        self.n = len(words)
        self.words = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=self.n)
        self.sums: dict[int, np.ndarray] = {}

    def _sums(self, which: int) -> np.ndarray:
        if which not in self.sums:
            up, _ = _powers.get(which, self.n)
            words = self.words if not which else _mixed(self.words)
            self.sums[which] = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * up, dtype=np.uint64)])
        return self.sums[which]

    def stretches(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from begin up to end, of any length."""
        sums, (_, down) = self._sums(1), _powers.get(1, self.n)
        return _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))

    def sequences(self, length: int, which: int = 0) -> np.ndarray:
        """Hash of the ``length`` words from each place on."""
        sums, (_, down), count = self._sums(which), _powers.get(which, self.n), self.n - length + 1
        return _mixed((sums[length:] - sums[:count]) * down[:count])


def _lengths(window: int) -> tuple[int, int]:
    first = -(-window // 4)
    return first, min(2 * first, window)


def _anchor_of(text: _Text, window: int) -> np.ndarray:
    """Place of the anchor of each window."""
    first, second = _lengths(window)
    count, spread = text.n - window + 1, window - second + 1
    grams = text.sequences(first)[: count + spread - 1]
    return np.arange(count) + np.lib.stride_tricks.sliding_window_view(grams, spread).argmin(axis=1)


def _repeated(key: np.ndarray, chk: np.ndarray | None, weight: np.ndarray) -> np.ndarray:
    """Whether each row's key (and chk) has a total weight of two or more."""
    if not len(key):
        return np.zeros(0, dtype=bool)
    order = np.argsort(key, kind="stable") if chk is None else np.lexsort((chk, key))
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    if chk is not None:
        c = chk[order]
        new[1:] |= c[1:] != c[:-1]
    begin = np.flatnonzero(new)
    total = np.add.reduceat(weight[order].astype(np.int64), begin)
    out = np.empty(len(key), dtype=bool)
    out[order] = np.repeat(total >= 2, np.diff(np.concatenate([begin, [len(key)]])))
    return out


def _batch(rows: dict[str, np.ndarray], names: list[str]) -> pa.RecordBatch:
    signed = [rows[n].view(np.int64) if rows[n].dtype == np.uint64 else rows[n] for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in signed], names=names)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {n: np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, dtype=k) for n, k in _KINDS.items()}


def _picked(rows: dict[str, np.ndarray], which: np.ndarray, **other) -> dict[str, np.ndarray]:
    found = {n: c[which] for n, c in rows.items()}
    return found | {n: np.full(len(found["key"]), v, dtype=_KINDS[n]) if np.isscalar(v) else v for n, v in other.items()}


def _ship(rows: dict[str, np.ndarray], also: str | None) -> pa.RecordBatch:
    """Rows for the next level: lone ones under their key, settled ones dealt evenly, one marker for each settled key.

    Rows settle if they share the key, and ``also`` where it is named, with another of these rows.
    """
    second = rows[also] if also else np.zeros(0, dtype=np.uint64)
    lone = rows["kind"] == LONE
    rep = _repeated(rows["key"], second if also else None, np.where(lone, 1, 2)) & lone
    at = np.flatnonzero(rep)
    pairs = np.stack([rows["key"][at], second[at] if also else np.zeros(len(at), dtype=np.uint64)], axis=1)
    _, first = np.unique(pairs, axis=0, return_index=True)
    even = _mixed((rows["id"][at] ^ rows["th"][at]).view(np.uint64) + rows["pos"][at].astype(np.uint64))
    return _batch(_joined([_picked(rows, ~rep), _picked(rows, at, key=even, kind=SETTLED), _picked(rows, at[first], kind=MARKER)]), list(_KINDS))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows of a partition sorted by key, some BLOCK_ROWS at a time; all rows of a key are together."""
    parts, size = [], 0
    for batch in batches:
        part = {}
        for k, (name, kind) in enumerate(_KINDS.items()):
            column = np.asarray(batch.column(k))
            part[name] = column.astype(np.int64).view(np.uint64) if kind == np.uint64 else column.astype(kind)
        parts.append(part)
        size += batch.num_rows
        if size >= BLOCK_ROWS:
            rows = _joined(parts)
            before = np.flatnonzero(rows["key"] != rows["key"][-1])
            if len(before):
                yield _picked(rows, slice(0, before[-1] + 1))
                rows = _picked(rows, slice(before[-1] + 1, None))
            # of one key a task has a row from each task before, and a marker: those wait for the rest
            parts, size = [rows], 0
    yield _joined(parts)


def _settled(rows: dict[str, np.ndarray], also: str | None) -> np.ndarray:
    """Which rows of whole groups repeat, by key and by ``also``; markers count twice and aren't named."""
    out, at = rows["kind"] == SETTLED, np.flatnonzero(rows["kind"] != SETTLED)
    rep = _repeated(rows["key"][at], rows[also][at] if also else None, np.where(rows["kind"][at] == MARKER, 2, 1))
    out[at[rep & (rows["kind"][at] == LONE)]] = True
    return out


def _raw(batch: pa.RecordBatch, text_col: str) -> Iterator[bytes]:
    for text in batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()):
        yield text.as_py() or b""


def _texts(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple]:
    """(id, th, text, runs or None) of each row."""
    for batch in batches:
        names = batch.schema.names
        ids, ths = (batch.column(names.index(n)).to_pylist() for n in ("_sub_id", "_sub_th"))
        runs = _runs(batch.column(names.index("_sub_runs"))) if "_sub_runs" in names else [None] * len(ids)
        for i, th, raw, run in zip(ids, ths, _raw(batch, text_col), runs, strict=True):
            yield i, th, _Text(raw), run


def _shipped(found: Iterator[tuple[int, dict]], also: str | None) -> Iterator[pa.RecordBatch]:
    """What is to be shipped of (words, rows) of one text after another, some BLOCK_WORDS at a time."""
    held, size = [], 0
    for words, rows in found:
        held.append(rows)
        size += words + 100
        if size >= BLOCK_WORDS:
            yield _ship(_joined(held), also)
            held, size = [], 0
    yield _ship(_joined(held), also)


def _runs(lists: pa.ListArray) -> list[list[np.ndarray]]:
    """Per row the fields of its runs, as arrays; a null list has none."""
    lists = lists.fill_null([]) if lists.null_count else lists
    ends = np.asarray(lists.offsets).tolist()
    fields = [np.asarray(f).astype(np.int64) for f in lists.values.flatten()]
    return [[f[a:b] for f in fields] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _rows_of(i: int, th: int, **columns) -> dict[str, np.ndarray]:
    n = len(columns["key"])
    given = columns | {"id": i, "th": th}
    return {name: given[name].astype(kind) if isinstance(given.get(name), np.ndarray) else np.full(n, given.get(name, 0), dtype=kind) for name, kind in _KINDS.items()}


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with _sub_id and _sub_th, an id and a hash of the text: equal rows share both, others are told apart."""
    text = text_of(text_col)
    return docs.withColumns({"_sub_id": F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)), "_sub_th": F.hash(text)})


def repeated_windows(rows: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """(_sub_id, _sub_th, _sub_runs): runs (pos, cnt) of the windows of each text that also start elsewhere."""
    first, second = _lengths(window)

    def anchors(batches):
        def found():
            for i, th, text, _ in _texts(batches, text_col):
                if text.n >= window:
                    at, pos, cnt = np.unique(_anchor_of(text, window), return_index=True, return_counts=True)
                    yield text.n, _rows_of(i, th, key=text.sequences(first)[at], chk=text.sequences(second)[at], seg=text.stretches(pos, pos + cnt - 1 + window), pos=pos, cnt=cnt)

        yield from _shipped(found(), None)
        _hashes.clear()

    def double(batches):
        for rows in _groups(batches):
            keep = _settled(rows, None)
            yield _ship(_picked(rows, keep, key=rows["chk"][keep], kind=LONE), "seg")

    def extend(batches):
        for rows in _groups(batches):
            done = _settled(rows, "seg")
            out = [_picked(rows, done, kind=SETTLED)]
            at = np.flatnonzero(rows["kind"] != SETTLED)
            if len(at):
                rest = _picked(rows, at)
                order = np.lexsort((rest["seg"], rest["key"]))
                rest = _picked(rest, order)
                new_key = np.concatenate([[True], rest["key"][1:] != rest["key"][:-1]])
                new = new_key | np.concatenate([[True], rest["seg"][1:] != rest["seg"][:-1]])
                group = np.cumsum(new_key) - 1
                several = (np.bincount(group, new) > 1)[group]  # stretches of one anchor differ: compare windows
                settled = _repeated(rest["key"], rest["seg"], np.where(rest["kind"] == MARKER, 2, 1))
                out += [_picked(rest, several & ~settled, kind=LONE), _picked(rest, several & settled & new, kind=MARKER)]
            yield _batch(_joined(out), RUN_NAMES)

    def whole(batches):
        def found():
            for i, th, text, (pos, cnt, kind) in _texts(batches, text_col):
                at = np.repeat(pos - np.concatenate([[0], np.cumsum(cnt)[:-1]]), cnt) + np.arange(cnt.sum())
                yield text.n, _rows_of(i, th, key=text.sequences(window)[at], chk=text.sequences(window, 1)[at], pos=at, cnt=np.ones(len(at)), kind=np.repeat(kind, cnt))

        yield from _shipped(found(), "chk")

    def compared(batches):
        for rows in _groups(batches):
            yield _batch(_picked(rows, _settled(rows, "chk"), kind=SETTLED), RUN_NAMES)

    def by_key(rows: DataFrame) -> DataFrame:
        """Sorted, so that a worker takes group after group and never a whole partition."""
        return rows.repartition("key").sortWithinPartitions("key")

    def of_each(runs: DataFrame, *fields: str) -> DataFrame:
        """Each run once: equal rows share their id and hash, and so would each get the runs of all."""
        return runs.groupBy(F.col("id").alias("_sub_id"), F.col("th").alias("_sub_th")).agg(F.collect_set(F.struct(*fields)).alias("_sub_runs"))

    bounded_batches(rows.sparkSession)
    level_1 = by_key(rows.mapInArrow(tidied(anchors), ROW))
    level_2 = by_key(level_1.mapInArrow(tidied(double), ROW))
    stretches = level_2.mapInArrow(tidied(extend), RUN)
    open_ = of_each(stretches.where(F.col("kind") != SETTLED), "pos", "cnt", "kind")
    # all columns go along, so that this join and the last one deal the texts out once
    windows = rows.join(open_, ["_sub_id", "_sub_th"]).select(*rows.columns, "_sub_runs").mapInArrow(tidied(whole), ROW)
    found = stretches.where(F.col("kind") == SETTLED).unionByName(by_key(windows).mapInArrow(tidied(compared), RUN))
    return of_each(found, "pos", "cnt")


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", rejoin: bool = True) -> DataFrame:
    """The rows of ``docs`` with what stays of their texts, and _sub_words and _sub_removed, the words before and those removed.

    Every word that lies in a repeated window goes; windows are judged on the input alone. What stays is joined by single blanks;
    with ``rejoin`` false a text that loses nothing stays as it is. Null and empty texts have no words; texts under one window keep all.
    Rows that share id and text each count as a document, so long ones lose their words. Texts of any length are read whole, one at a time; empty
    tables give no rows; only columns named _sub_id, _sub_th, _sub_runs, _sub_words or _sub_removed clash.
    """
    schema = with_fields(docs, _sub_words="long", _sub_removed="long")

    def cut(batches):
        for batch in batches:
            before, removed, kept = [], [], []
            at = batch.schema.get_field_index(text_col)
            for k, (raw, (pos, cnt)) in enumerate(zip(_raw(batch, text_col), _runs(batch.column(batch.num_columns - 1)), strict=True)):
                words = raw.split()
                before.append(len(words))
                if len(pos):
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, pos, 1)
                    np.subtract.at(edge, pos + cnt - 1 + window, 1)
                    words = [w for w, s in zip(words, (np.cumsum(edge)[:-1] == 0).tolist(), strict=True) if s]
                removed.append(before[-1] - len(words))
                kept.append(b" ".join(words).decode() if rejoin or removed[-1] else batch.column(at)[k].as_py())
            columns = [pa.array(kept, pa.string()) if k == at else c for k, c in enumerate(batch.columns[: len(docs_columns)])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(removed, pa.int64())], names=[*docs_columns, "_sub_words", "_sub_removed"])

    docs_columns, rows = docs.columns, keyed(docs, id_col, text_col)
    found = repeated_windows(rows, window, text_col)
    joined = rows.join(found, ["_sub_id", "_sub_th"], "left").select(*docs_columns, "_sub_runs")
    return joined.mapInArrow(tidied(cut), schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated passages; rows stay, texts that lose nothing (null ones, too) stay as they are."""
    out = without_repeats(docs, rejoin=False)
    if "n_chars" in docs.columns:
        size = F.when(F.col("_sub_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))
        out = out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = without_repeats(docs)
    return out.select("doc_id", F.col("_sub_words").alias("n_words"), F.col("_sub_removed").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
