"""Phrase collocations by Rabin-Karp fingerprints.

Numpy prefix polynomials over word hashes give every n-gram of a block of texts a fingerprint and a check value in a few vector
operations. A first pass ships packed halves of the fingerprints of words and pairs, no more copies of each per block than make it frequent, and counts
them by bucket; what is frequent there becomes a bitmap of fixed size. Each further length has a pass of its own, over phrases whose shorter
ones are frequent at both ends: no others can be. The last pass gathers what the bitmaps let through and ships each fingerprint with its count and a
pointer (hash of the row, place in its text); the shuffle adds the counts up.

Phrases exist as text only once their fingerprint is frequent: the pointer leads to the words, whose fingerprint must come out again. Where
one fingerprint has met two check values, or a pointer leads to other words, occurrences are counted anew by their words; so no collision
reaches the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import bounded_batches
from corpusloom.sources.shared import materialise

LONGEST, LEAST_COUNT, SHARE, BEST = 3, 10, 50, 2_000
UNKNOWN = "und"
#: Words that a task looks at together before it ships rows, and words whose hashes a worker keeps.
BLOCK_WORDS, KEPT_WORDS = 1_000_000, 200_000
#: Bits of the bitmap of frequent fingerprints. More of them than bits make it let more pass, never less.
BITMAP = 1 << 27
#: Buckets of the first pass for each shuffle partition; one is counted at a time.
BUCKETS = 4
#: Parts in which a language's phrases are ranked before the last ranking.
SALT = 16
#: Fingerprints that a task gathers, over its blocks, before it ships them.
GATHERED = 1_500_000
BREAK, BREAKS = b"\xff", re.compile(rb"[.,;:!?\x0A-\x0D]+")
#: Odd multipliers of the two polynomials, of the language and of the mixing step.
_BASES, _LANG = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: What is shipped of a fingerprint: itself; 28 bits of check value, 4 of size and 32 of count; 40 bits of the row's hash and 24 of the place.
GRAM = "fp long, told long, place long"
CHECK, ROW, AT, KEYS = 28, 40, 24, 4_000_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KEPT_WORDS:
            self.clear()
            self[BREAK] = 0
        found = self[word] = xxhash.xxh64_intdigest(word) or 1
        return found


_hashes = _WordHash({BREAK: 0})


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of both bases and of their inverses modulo 2**64, grown as blocks ask for them."""

    def __init__(self):
        self.tables = [np.ones((2, 1), dtype=np.uint64) for _ in _BASES]

    def get(self, which: int, n: int) -> np.ndarray:
        if self.tables[which].shape[1] < n:
            pair = np.array([[_BASES[which]], [pow(_BASES[which], -1, 1 << 64)]], dtype=np.uint64)
            steps = np.repeat(pair, n + n // 8, axis=1)
            steps[:, 0] = 1
            self.tables[which] = np.cumprod(steps, axis=1, dtype=np.uint64)
        return self.tables[which][:, :n]


_powers = _Powers()


def pieces_and_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in small letters, and a BREAK between two pieces."""
    return BREAKS.sub(b" " + BREAK + b" ", (text or "").encode().lower()).split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


class Block:
    """The words of some texts, as hashes, in one array, with a break after each text."""

    def __init__(self, texts: list[tuple[int, str, np.ndarray]], bits: tuple[int, int] = (64, CHECK)):
        gap = np.zeros(1, dtype=np.uint64)
        sizes = np.array([len(words) + 1 for _, _, words in texts], dtype=np.int64)
        self.words = np.concatenate([x for _, _, words in texts for x in (words, gap)])
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.rows = np.array([row for row, _, _ in texts], dtype=np.int64)
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        self.lang = (np.array([_hashes[b"lang " + lang.encode()] for _, lang, _ in texts], dtype=np.uint64) * _LANG)[self.text]
        self.breaks = np.concatenate([[0], np.cumsum(self.words == 0)]).astype(np.int32)
        self.masks = [np.uint64((1 << b) - 1) for b in bits]
        self.sums: dict[int, np.ndarray] = {}

    def _sums(self, which: int) -> np.ndarray:
        if which not in self.sums:
            words = self.words if not which else _mixed(self.words)
            self.sums[which] = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * _powers.get(which, len(words))[0], dtype=np.uint64)])
        return self.sums[which]

    def fingerprints(self, size: int, which: int) -> np.ndarray:
        """Of the ``size`` words from each place on, told apart by language and size."""
        count = max(len(self.words) - size + 1, 0)
        down = _powers.get(which, len(self.words))[1][:count]
        sums = self._sums(which)
        window = (sums[size : size + count] - sums[:count]) * down
        return _mixed(window + self.lang[:count] + np.uint64(size)) & self.masks[which]

    def whole(self, size: int) -> np.ndarray:
        """Places from which ``size`` words stand in one piece."""
        count = max(len(self.words) - size + 1, 0)
        return np.flatnonzero(self.breaks[size : size + count] == self.breaks[:count])


def _gathered(size: int, fp: np.ndarray, chk: np.ndarray, at: np.ndarray, block: Block) -> list[np.ndarray]:
    """One row per fingerprint and check value of the block, with its count and its first place."""
    text = block.text[at]
    # a place that doesn't fit leads nowhere, and its phrase is counted by its words
    place = np.minimum(at - block.first[text], (1 << AT) - 1)
    return _added([np.full(len(at), size, dtype=np.int8), fp, chk, np.ones(len(at), dtype=np.int64), block.rows[text], place.astype(np.int32)])


def _added(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of one fingerprint, size and check value made one: counts are added, the first pointer stays."""
    size, fp, chk, cnt = columns[:4]
    order = np.argsort(fp, kind="stable")
    f, rest = fp[order], (size[order], chk[order])
    same = f[1:] == f[:-1]
    if (same & ((rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1]))).any():  # a collision among these rows
        order = np.lexsort((chk, size, fp))
        f, rest = fp[order], (size[order], chk[order])
        same = (f[1:] == f[:-1]) & (rest[0][1:] == rest[0][:-1]) & (rest[1][1:] == rest[1][:-1])
    begin = np.flatnonzero(np.concatenate([[True], ~same])) if len(f) else np.zeros(0, dtype=np.int64)
    out = [c[order[begin]] for c in columns]
    out[3] = np.add.reduceat(cnt[order], begin) if len(f) else cnt
    return out


def _shipped(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows packed into three numbers: most of what is written and read in the shuffle of counts is this."""
    size, fp, chk, cnt, row, at = (c.astype(np.uint64) for c in columns)
    out = fp, chk << np.uint64(36) | size << np.uint64(32) | cnt, row << np.uint64(AT) | at
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in out], names=["fp", "told", "place"])


def _blocks(batches: Iterator[pa.RecordBatch], bits: tuple[int, int]) -> Iterator[Block]:
    """Blocks of (row, lang, text) rows; a text stands whole in one block."""
    held, size = [], 0
    for batch in batches:
        for row, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = hashed(pieces_and_words(text.as_py()))
            held.append((row, lang, words))
            size += len(words) + 1
            if size >= BLOCK_WORDS:
                yield Block(held, bits)
                held, size = [], 0
    if held:
        yield Block(held, bits)


def _split(fp: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket, by the lower half, and the highest 24 bits of fingerprints: buckets are as many as the input asks for, so 24 bits stay enough."""
    return (fp & np.uint64(0xFFFFFFFF)) % np.uint64(buckets), fp >> np.uint64(40)


def _place(bucket: np.ndarray, half: np.ndarray, size: int) -> np.ndarray:
    """The bit that stands for a bucket and a half."""
    return _mixed(bucket * _LANG + half) & np.uint64(size - 1)


def _marked(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _capped(keys: np.ndarray, most: int) -> np.ndarray:
    """Sorted keys with at most so many copies of each."""
    keep = np.ones(len(keys), dtype=bool)
    keep[most:] = keys[most:] != keys[:-most]
    return keys[keep]


def bitmap_of(places: DataFrame, size: int = BITMAP) -> np.ndarray:
    """A bitmap of ``places(place)``: built by Spark in parts of 32,768 bits; its size doesn't depend on the input."""
    parts = places.select((F.col("place") + 1).alias("p")).groupBy(F.call_function("bitmap_bucket_number", F.col("p")).alias("k"))
    parts = parts.agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("p"))).alias("bits"))
    out = np.zeros(size // 8, dtype=np.uint8)
    for k, bits in zip(*parts.toArrow().to_pydict().values(), strict=True):
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bits, dtype=np.uint8)
    return out


def frequent_places(rows: DataFrame, sizes: tuple[int, ...], below: Broadcast | None, least: int, buckets: int, bits: tuple[int, int] = (64, CHECK), size: int = BITMAP) -> DataFrame:
    """(place): the bits of all phrases of these sizes that occur ``least`` times or more, of rows(row, lang, text); of some others that share half and
    bucket, too. With ``below``, the bitmap of the next smaller size, phrases that have a rare one at either end are left out."""

    def halves(batches):
        held = []
        for block in _blocks(batches, bits):
            for n in sizes:
                at = block.whole(n)
                if below is not None:
                    shorter = _marked(below.value, _place(*_split(block.fingerprints(n - 1, 0), buckets), size))
                    at = at[shorter[at] & shorter[at + 1]]
                bucket, half = _split(block.fingerprints(n, 0)[at], buckets)
                held.append(bucket << np.uint64(24) | half)
            # more than `least` copies are as good as so many
            held = [_capped(np.sort(np.concatenate(held)), least)]
            if len(held[0]) >= KEYS:
                yield packed(held[0])
                held = []
        if held:
            yield packed(held[0])

    def packed(keys):
        edges = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(24))
        three = keys.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        met = np.flatnonzero(np.diff(edges)).tolist()
        return pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([three[3 * edges[k] : 3 * edges[k + 1]] for k in met], pa.binary())], names=["bucket", "halves"])

    def counted(batches):
        def frequent(bucket, held):
            three = np.frombuffer(b"".join(held), dtype=np.uint8).reshape(-1, 3).astype(np.uint32)
            halves = np.sort(three[:, 0] | three[:, 1] << np.uint32(8) | three[:, 2] << np.uint32(16))
            found = np.unique(halves[least - 1 :][halves[least - 1 :] == halves[: len(halves) - least + 1]]).astype(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(_place(np.uint64(bucket), found, size).view(np.int64))], names=["place"])

        now, held = None, []
        for batch in batches:
            for bucket, halves in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now:
                    if held:
                        yield frequent(now, held)
                    now, held = bucket, []
                held.append(halves)
        if held:
            yield frequent(now, held)

    dealt = rows.mapInArrow(halves, "bucket int, halves binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(counted, "place long")


def _summed(grams: DataFrame, least: int, tag: str) -> DataFrame:
    """Frequent fingerprints. Tasks have combined their rows already, so rows are dealt out once and added up there."""
    one = grams.repartition("fp").select(
        "fp", F.shiftrightunsigned("told", 36).alias("chk"), F.shiftright("told", 32).bitwiseAND(F.lit(15)).cast("byte").alias("size"), F.col("told").bitwiseAND(F.lit((1 << 32) - 1)).alias("cnt"),
        F.shiftrightunsigned("place", AT).alias("row"), F.col("place").bitwiseAND(F.lit((1 << AT) - 1)).cast("int").alias("at"),
    )
    one = one.groupBy("fp", "size").agg(F.sum("cnt").alias("cnt"), F.min("chk").alias("chk"), F.max("chk").alias("chk2"), F.min("row").alias("row"), F.min_by("at", "row").alias("at"))
    return materialise(one.where((F.col("cnt") >= least) | (F.col("size") == 0)), tag)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, lang_col: str = "lang", text_col: str = "text", bits: tuple[int, int] = (64, CHECK)) -> DataFrame:
    """(lang, size, phrase, cnt) of the phrases of 1 to ``longest`` words that occur ``least`` times or more in a language, counted exactly, and
    for each language with words a row of size 0 with the number of its words.

    ``bits`` narrows fingerprints and check values, for tests of collisions.
    """
    session = docs.sparkSession
    bounded_batches(session)
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(lang, text).bitwiseAND(F.lit((1 << ROW) - 1)).alias("row"), lang.alias("lang"), text.alias("text"))

    buckets = BUCKETS * int(session.conf.get("spark.sql.shuffle.partitions"))
    known = [session.sparkContext.broadcast(bitmap_of(frequent_places(rows, (1, 2), None, least, buckets, bits)))]
    for size in range(3, longest + 1):
        known.append(session.sparkContext.broadcast(bitmap_of(frequent_places(rows, (size,), known[-1], least, buckets, bits))))

    def pointed(batches):
        held = []
        for block in _blocks(batches, bits):
            for size in range(1, longest + 1):
                at, fp = block.whole(size), block.fingerprints(size, 0)
                at = at[_marked(known[max(size - 2, 0)].value, _place(*_split(fp[at], buckets), BITMAP))]
                held.append(_gathered(size, fp[at], block.fingerprints(size, 1)[at], at, block))
            at = block.whole(1)  # words of each language, under its fingerprint
            tongue = _mixed(block.lang[at])
            held.append(_gathered(0, tongue & block.masks[0], _mixed(~tongue) & block.masks[1], at, block))
            del block
            held = [_added([np.concatenate(c) for c in zip(*held, strict=True)])]
            if len(held[0][0]) >= GATHERED:
                yield _shipped(held[0])
                held = []
        if held:
            yield _shipped(held[0])

    found = _summed(rows.mapInArrow(pointed, GRAM), least, "phrases-found")
    told = materialise(_read(rows, found, bits), "phrases-read")
    doubtful = told.where("not sure").select("fp", "size")
    sure = told.where("sure").select("lang", "size", "phrase", "cnt")
    return sure if doubtful.isEmpty() else sure.unionByName(_counted(rows, doubtful, longest, least, bits))


def _read(rows: DataFrame, found: DataFrame, bits: tuple[int, int]) -> DataFrame:
    """(fp, size, cnt, sure, lang, phrase): the words that the pointers lead to, and whether they can be no others."""
    pointed = found.groupBy("row").agg(F.collect_list(F.struct("size", "fp", "chk", "chk2", "cnt", "at")).alias("grams"))
    pointed = materialise(pointed, "phrases-pointed")
    known = rows.sparkSession.sparkContext.broadcast(bitmap_of(pointed.select(F.pmod("row", F.lit(BITMAP)).alias("place"))))

    def asked(batches):  # texts that no pointer leads to, and copies inside a batch, go no further
        met: set[int] = set()
        for batch in batches:
            at = np.asarray(batch.column(0))
            marked = np.flatnonzero(_marked(known.value, at.view(np.uint64) & np.uint64(BITMAP - 1))).tolist()
            kept = [k for k in marked if at[k] not in met]
            if len(met) > KEPT_WORDS:
                met.clear()
            met.update(at[kept].tolist())
            yield batch.take(pa.array(kept, pa.int64()))

    texts = rows.mapInArrow(asked, rows.schema).dropDuplicates(["row"])

    def read(batches):
        for batch in batches:
            out = {n: [] for n in ("fp", "size", "cnt", "sure", "lang", "phrase")}
            for row, lang, text, grams in zip(*(batch.column(k) for k in range(4)), strict=True):
                words = pieces_and_words(text.as_py())
                block, lang, grams = Block([(row.as_py(), lang.as_py(), hashed(words))], bits), lang.as_py(), grams.values.flatten()
                size, fp, chk, chk2, cnt, at = (np.asarray(g) for g in grams)
                true = chk == chk2
                for s in set(size.tolist()):
                    these = np.flatnonzero(size == s)
                    if not s:
                        tongue = _mixed(np.repeat(block.lang[:1], len(these)))
                        pair = tongue & block.masks[0], _mixed(~tongue) & block.masks[1]
                    else:
                        inside = at[these] + s <= len(words)
                        true[these] &= inside
                        there = np.where(inside, at[these], 0)
                        pair = [block.fingerprints(s, w)[there] if len(words) >= s else np.zeros(len(these), dtype=np.uint64) for w in range(2)]
                    true[these] &= (pair[0].view(np.int64) == fp[these]) & (pair[1].view(np.int64) == chk[these])
                out["fp"].append(fp)
                out["size"].append(size)
                out["cnt"].append(cnt)
                out["sure"].append(true)
                out["lang"] += [lang] * len(fp)
                out["phrase"] += [b" ".join(words[a : a + s]).decode() for a, s in zip(at.tolist(), size.tolist(), strict=True)]
            flat = {n: np.concatenate(v) if n not in ("lang", "phrase") else v for n, v in out.items()} if out["fp"] else out
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(flat.values(), (pa.int64(), pa.int8(), pa.int64(), pa.bool_(), pa.string(), pa.string()), strict=True)], names=list(flat))

    met = texts.join(pointed, "row").select("row", "lang", "text", "grams").mapInArrow(read, "fp long, size byte, cnt long, sure boolean, lang string, phrase string")
    return met


def _counted(rows: DataFrame, doubtful: DataFrame, longest: int, least: int, bits: tuple[int, int]) -> DataFrame:
    """Phrases behind doubtful fingerprints, counted by their words."""
    doubtful = materialise(doubtful.distinct(), "phrases-doubtful")
    known = rows.sparkSession.sparkContext.broadcast(bitmap_of(doubtful.select(F.pmod("fp", F.lit(BITMAP)).alias("place"))))

    def spelt(batches):
        for batch in batches:
            counts: dict[tuple, int] = {}
            for row, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = pieces_and_words(text)
                block = Block([(row, lang, hashed(words))], bits)
                for size in range(1, longest + 1):
                    at, fp = block.whole(size), block.fingerprints(size, 0)
                    at = at[_marked(known.value, fp[at] & np.uint64(BITMAP - 1))]
                    for f, a in zip(fp[at].view(np.int64).tolist(), at.tolist(), strict=True):
                        key = (f, size, lang, b" ".join(words[a : a + size]))
                        counts[key] = counts.get(key, 0) + 1
                tongue, n = int((_mixed(block.lang[:1]) & block.masks[0]).view(np.int64)[0]), len(block.whole(1))
                if n:
                    counts[tongue, 0, lang, b""] = counts.get((tongue, 0, lang, b""), 0) + n
            fps, sizes, langs, phrases = zip(*counts, strict=True) if counts else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(fps, pa.int64()), pa.array(sizes, pa.int8()), pa.array(langs, pa.string()), pa.array([p.decode() for p in phrases], pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["fp", "size", "lang", "phrase", "cnt"],
            )

    each = rows.mapInArrow(spelt, "fp long, size byte, lang string, phrase string, cnt long").join(doubtful, ["fp", "size"], "left_semi")
    return each.groupBy("lang", "size", "phrase").agg(F.sum("cnt").alias("cnt")).where((F.col("cnt") >= least) | (F.col("size") == 0))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, share: int = SHARE, best: int = BEST, lang_col: str = "lang", text_col: str = "text", bits: tuple[int, int] = (64, CHECK)) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases of 2 to ``longest`` words that occur ``least`` times or more.

    A phrase's score is the lowest over its cuts into two, in millionths of a * a / (l * r), floored in whole numbers of 38 digits; phrases that lie
    in a longer candidate of at least ``share`` percent of their occurrences go. Null languages are ``und``, null and empty texts have no
    words; repeated rows count as often as they stand there; ties go by a, then by the bytes of the phrase. A text of any length is in one block.
    Empty tables give no rows, and further columns, whatever their names, are ignored.
    """
    counted = materialise(frequent_phrases(docs, longest, least, lang_col, text_col, bits), "phrases")
    f = counted.where("size > 0")
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("head"), F.array_join(F.slice("w", k + 1, F.size("w")), " ").alias("tail")))
    candidates = f.where("size > 1").select("lang", "phrase", F.col("size").cast("int").alias("size"), F.col("cnt").alias("a"))
    cut = candidates.withColumn("w", words).select("lang", "phrase", "size", "a", F.inline(cuts))
    part = lambda side, name: f.select("lang", F.col("phrase").alias(side), F.col("cnt").alias(name))
    valued = cut.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    # whole numbers of 38 digits; div is exact
    score = F.expr("cast(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)")
    lowest = valued.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("v")).select("lang", "phrase", "v.*")
    inner = F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " ")))
    longer = candidates.where("size > 2").withColumn("w", words).select("lang", F.explode(F.array_distinct(F.flatten(inner))).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * share, F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("_part", F.pmod(F.hash("phrase"), F.lit(SALT)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    n = counted.where("size = 0").select("lang", F.col("cnt").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places, (VALUES (1), (2), (3)) AS s(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM candidates),
valued AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cuts.c, h.a AS l, t.a AS r, CAST(1000000 AS HUGEINT) * cuts.a * cuts.a // (CAST(h.a AS HUGEINT) * t.a) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = array_to_string(w[1:c], ' ') JOIN f t ON t.lang = cuts.lang AND t.phrase = array_to_string(w[c + 1:], ' ')),
lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE k = 3)
  GROUP BY ALL),
kept AS (SELECT v.* FROM lowest v LEFT JOIN longer g USING (lang, phrase) WHERE g.a IS NULL OR 100 * g.a < 50 * v.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, kept.a DESC, phrase) AS rank, phrase, kept.a AS a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
