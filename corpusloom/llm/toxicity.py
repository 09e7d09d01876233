"""Toxicity of whole texts, scored on words restored by a noisy-channel decoder.

The source model is a character trigram model counted over every text of the table. Words that may be disguised (a letter and look-alike digits
or signs at any place, letters of two scripts, letters repeated three times or more, letters set apart) become lattices of what each sign may stand for, and the
Viterbi path through a lattice under the trigram model is the word that is scored. The score is a logistic model on the presence of
restored words and their beginnings, learned from labelled rows outside the held-out quarter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import bounded_batches, text_of, tidied, with_fields
from corpusloom.sources.shared import materialise

#: Bounds of what is fitted: labelled rows that teach (chosen by hash of their id), and features.
LABELLED_ROWS, FEATURES, LEAST_SUPPORT = 20_000, 4_096, 4
THRESHOLD, HELD_OUT, FOLDS = 0.3, 2, 4
#: Words of one generation of a worker's memory; what a full, older one holds moves on when it is asked for again.
KEPT_WORDS = 150_000
#: Characters whose trigrams are counted at once.
PORTION = 2_000_000
# Letters that digits and signs are written for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
#: The same in Cyrillic words, and Cyrillic letters that stand for Latin ones in words of both scripts.
CYRILLIC_LOOK_ALIKES = {"0": "о", "1": "і", "3": "з", "4": "ч", "6": "б", "8": "в", "@": "а", "$": "с"}
TWINS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h"}
#: Costs of the channel, in nats: a look-alike, a run written longer, a mark set between letters, a sign that is just a mark.
SWAP, STRETCH, APART, BREAK = 0.5, 0.5, 0.2, 2.0
_SIGNS = re.escape("".join({**LOOK_ALIKES, **CYRILLIC_LOOK_ALIKES}))
DISGUISED = re.compile(rf"[^\W\d_].*[{_SIGNS}]|[{_SIGNS}].*[^\W\d_]|([^\W\d_])\1\1|[a-z].*[а-яі]|[а-яі].*[a-z]", re.DOTALL)
CYRILLIC, LATIN = re.compile("[а-яёі]"), re.compile("[a-z]")
SET_APART = re.compile(r"(?:^|(?<=\s)|(?<=^[^\w\s])|(?<=\s[^\w\s]))[^\W\d_](?:[ .\-_*][^\W\d_]){2,}(?=[^\w\s]*(?:\s|$))")
#: What every stretch of letters set apart holds; cheaper to look for.
LETTER_APART = re.compile(r"[ .\-_*][^\W\d_][ .\-_*][^\W\d_](?![^\W\d_])")
#: Letters, with signs after them that stand for none; and what makes such a word a disguise nevertheless.
LETTERS, DOUBTFUL = re.compile(r"([^\W\d_]+)[.,;:?)\"'*&%-]*"), re.compile(r"([^\W\d_])\1\1|[а-яі]")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
CODES = 128


def _alphabet() -> np.ndarray:
    """Codes of the 16-bit units: small letters of Latin-1, Greek and Cyrillic have their own, other letters share one, and everything
    else is a boundary (0)."""
    letters = [c for c in (*range(256), *range(0x3B1, 0x3CA), *range(0x430, 0x450), 0x451, 0x454, 0x456, 0x457) if chr(c).isalpha() and chr(c) == chr(c).lower()]
    if len(letters) + 1 >= CODES:
        raise ValueError("the alphabet doesn't fit the codes")
    table = np.array([CODES - 1 if chr(c).isalpha() else 0 for c in range(1 << 16)], dtype=np.int32)
    table[letters] = np.arange(1, len(letters) + 1)
    return table


ALPHABET = _alphabet()


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): character trigrams of all lower-cased texts; a task hands on one row per trigram that it has met."""

    def tally(texts: list[str]) -> np.ndarray:
        joined = "  ".join(["", *texts, ""]).lower()
        code = ALPHABET[np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), dtype="<u2")]
        return np.bincount((code[:-2] * CODES + code[1:-1]) * CODES + code[2:], minlength=CODES**3)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, portion, size = np.zeros(CODES**3, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                portion.append(text)
                size += len(text)
                if size >= PORTION:
                    total += tally(portion)
                    portion, size = [], 0
        total += tally(portion)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["code", "n"])

    return docs.select(text_of(text_col)).mapInArrow(tidied(count), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def trigram_model(counts: DataFrame) -> np.ndarray:
    """Log-probabilities [a, b, c] of c after a, b, mixed with those of shorter histories. At most 128**3 counts reach the driver."""
    table = np.zeros(CODES**3, dtype=np.float32)
    for row in counts.collect():
        table[row.code] = row.n
    three = table.reshape(CODES, CODES, CODES)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + CODES)
    p2 = (two + 50 * p1) / (two.sum(1, keepdims=True) + 50)
    totals = three.sum(2, keepdims=True) + 50
    three += (50 * p2)[None]
    three /= totals
    return np.log(three, out=three)


class Decoder:
    """Viterbi search of the lattices under a trigram model."""

    def __init__(self, model: np.ndarray):
        self.model = model

    @staticmethod
    def lattice(word: str) -> list[list[tuple[float, str]]]:
        """What each run of one sign may stand for, with its cost; a blank stands for a boundary."""
        arcs, apart, cyrillic = [], bool(SET_APART.fullmatch(word)), bool(CYRILLIC.search(word))
        mixed, look_alikes = cyrillic and bool(LATIN.search(word)), dict(LOOK_ALIKES)
        if cyrillic:
            for sign, letter in CYRILLIC_LOOK_ALIKES.items():
                look_alikes[sign] = look_alikes.get(sign, "") * mixed + letter
        for run in re.finditer(r"(.)\1*", word, re.DOTALL):
            sign, n = run[1], len(run[0])
            if sign.isalpha():
                signs = [(0.0, sign)] + ([(SWAP, TWINS[sign])] if mixed and sign in TWINS else [])
                arcs.append([(cost, c * n) for cost, c in signs] if n < 3 else [(cost + STRETCH, c * m) for cost, c in signs for m in (1, 2)])
            elif sign in look_alikes:
                # as for letters, one or two stand for as many and only longer runs are stretched
                letters = [(SWAP, c * n) if n < 3 else (SWAP + STRETCH, c * m) for c in look_alikes[sign] for m in range(1, 2 + (n > 2))]
                arcs.append(letters + [(BREAK, " ")])
            else:
                arcs.append([(APART if n == 1 else 2 * APART, ""), (BREAK, " ")] if apart or sign in ".-_* " else [(0.0, " ")])
        return arcs

    def restore(self, word: str) -> str:
        """The likeliest reading of a disguised stretch; of equal readings the first in the lattice's order."""
        code = lambda c: int(ALPHABET[ord(c)]) if ord(c) < 1 << 16 else 0
        best = {(0, 0): (0.0, None)}
        for arcs in [*self.lattice(word), [(0.0, " ")]]:
            following: dict = {}
            for (a, b), (score, path) in best.items():
                for cost, letters in arcs:
                    total, x, y = score - cost, a, b
                    for c in letters:
                        z = code(c)
                        total += float(self.model[x, y, z])
                        x, y = y, z
                    if (x, y) not in following or total > following[x, y][0]:
                        following[x, y] = (total, (path, letters))
            best = following
        path, parts = max(best.values(), key=lambda v: v[0])[1], []
        while path is not None:
            path, letters = path
            parts.append(letters)
        return "".join(reversed(parts)).strip()


def features_of(decoder: Decoder) -> Callable[[str], tuple[str, ...]]:
    """From a lower-cased word (no white space) to its features: the restored words and their first four and five letters."""

    def features(word: str) -> tuple[str, ...]:
        plain = LETTERS.fullmatch(word)
        if plain and not DOUBTFUL.search(word):
            w = plain[1]
            return (w, f"{w[:4]}~", f"{w[:5]}~")[: 1 + (len(w) > 4) + (len(w) > 5)]
        found = []
        inner = EDGES.sub("", word)
        restored = decoder.restore(inner) if SET_APART.fullmatch(inner) else decoder.restore(word) if DISGUISED.search(word) else word
        for w in restored.split():
            w = EDGES.sub("", w)
            if w:
                found.append(w)
                found += [f"{w[:k]}~" for k in (4, 5) if len(w) > k]
        return tuple(found)

    return features


def words_of(text: str, decoder: Decoder) -> set[str]:
    """Distinct lower-cased words; letters set apart over several words are read as one stretch."""
    low = text.lower()
    words = set(low.split())
    for m in SET_APART.finditer(low) if LETTER_APART.search(low) else ():
        if " " in m[0] and len(set(m[0]) - set(" .-_*")) > 2:
            words.update(decoder.restore(m[0]).split())
    return words


class Kept(dict):
    def __init__(self, make: Callable):
        self.make, self.older = make, {}

    def __missing__(self, key):
        if len(self) >= KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def teaching_rows(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled documents outside the held-out quarter, chosen by a hash of their id."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_known"), F.col("toxic").alias("_toxic"))
    texts = docs.select(F.col("doc_id").alias("_id"), text_of().alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_known")).select("text", F.col("_toxic").cast("int").alias("toxic"))
    return materialise(rows.repartition(docs.sparkSession.sparkContext.defaultParallelism), "tox-teach")


def learn(teaching: DataFrame, model: np.ndarray) -> dict[str, float]:
    """Weights by feature, "" for the constant. The driver holds no more than the bounded sample's chosen features."""
    shared = teaching.sparkSession.sparkContext.broadcast(model)

    def reader():
        decoder = Decoder(shared.value)
        return decoder, Kept(features_of(decoder))

    def tally(batches):
        (decoder, kept), toxic, clean = reader(), Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update({f for w in words_of(text, decoder) for f in kept[w]})
        names = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()), pa.array([clean[f] for f in names], pa.int64())], names=["feature", "toxic", "clean"])

    n = teaching.groupBy().agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count("*").alias("rows")).first()
    n_toxic, n_clean = int(n.toxic), int(n.rows - n.toxic)
    if not n_toxic or not n_clean:
        share = (n_toxic + 0.5) / (n.rows + 1)  # one class or none to learn from: its share is every score
        return {"": math.log(share / (1 - share))}
    sums = teaching.mapInArrow(tally, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sums = sums.where(F.col("toxic") + F.col("clean") >= LEAST_SUPPORT)
    p, q = (F.col("toxic") + 0.5) / (n_toxic + 1.0), (F.col("clean") + 0.5) / (n_clean + 1.0)
    gain = F.abs(F.col("toxic") * F.log(p / q)) + F.abs(F.col("clean") * F.log(q / p)) * 0.1
    chosen = [r.feature for r in sums.orderBy(gain.desc(), "feature").limit(FEATURES).collect()]
    index = {f: k for k, f in enumerate(chosen)}

    def present(batches):
        decoder, kept = reader()
        for batch in batches:
            rows = [sorted({index[f] for w in words_of(text, decoder) for f in kept[w] if f in index}) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], names=["present", "toxic"])

    sample = teaching.mapInArrow(present, "present array<int>, toxic int").toArrow()
    weights = logistic(sample.column("present").to_pylist(), np.array(sample.column("toxic").to_pylist(), dtype=float), len(chosen))
    return {"": float(weights[-1])} | {f: float(w) for f, w in zip(chosen, weights, strict=False)}


def logistic(present: list[list[int]], target: np.ndarray, size: int, ridge: float = 0.3, steps: int = 200) -> np.ndarray:
    """Ridge logistic regression by Adagrad steps on all rows; the constant is last and not shrunk."""
    row = np.repeat(np.arange(len(present)), [len(p) for p in present])
    column = np.concatenate([np.array(p, dtype=np.int64) for p in present]) if len(row) else np.zeros(0, dtype=np.int64)
    weights, squares = np.zeros(size + 1), np.full(size + 1, 1e-8)
    order = np.lexsort((row, column))
    row, column = row[order], column[order]
    for _ in range(steps):
        z = np.bincount(row, weights[column], minlength=len(target)) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        slope = np.append(np.bincount(column, error[row], minlength=size) + ridge * weights[:-1], error.sum())
        squares += slope**2
        weights -= 0.5 * slope / np.sqrt(squares)
    return weights


def scored(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``_tox_score`` (0 to 1, higher: likelier toxic) beside their own columns.

    Null and empty texts get the score of a text without features. Rows with equal texts get equal scores. Repeated labels of
    one document count as toxic if one of them does; where no label of one class is left, each score is the share of toxic ones. Texts of any
    length are read whole, one at a time; empty tables give no rows; only a column named _tox_score clashes.
    """
    bounded_batches(docs.sparkSession)
    model = trigram_model(trigram_counts(docs, text_col))
    weights = learn(teaching_rows(docs.withColumn("text", F.col(text_col)), labels), model)
    context = docs.sparkSession.sparkContext
    shared, taught, at = context.broadcast(model), context.broadcast(weights), docs.columns.index(text_col)

    def score(batches):
        decoder, weight = Decoder(shared.value), taught.value
        read = features_of(decoder)
        kept = Kept(lambda w: tuple(f for f in read(w) if f in weight))
        for batch in batches:
            sums = []
            for value in batch.column(at):  # one text at a time beside its batch
                found = {f for hit in map(kept.__getitem__, words_of(str(value.as_py() or ""), decoder)) if hit for f in hit}
                sums.append(weight[""] + sum(weight[f] for f in sorted(found)))
            probability = 1 / (1 + np.exp(-np.clip(np.array(sums, dtype=float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probability)], names=[*batch.schema.names, "_tox_score"])

    return docs.mapInArrow(tidied(score), with_fields(docs, _tox_score="double"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
    return rows.select("doc_id", held_out().alias("held_out"), F.col("_tox_score").alias("score"), (F.col("_tox_score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not rejected, in their own columns; null and empty texts stay as a text without features does, repeated rows together."""
    rows = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.where(F.col("_tox_score") < THRESHOLD).select(*docs.columns)
