"""Quality of whole texts: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text is a sparse vector: words and runs of signs in small letters, words' shapes, and pairs of neighbours of either kind are hashed to
2**18 places; each place weighs the root of its share of the text. Labelled texts are turned into such vectors once, dealt to a fixed number of
shards by a hash of their id, and learned there by FTRL-Proximal; after each round the shards' states are averaged place by place and
handed to the next. A score is the sparse dot product with the weights, through the logistic function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import bounded_batches, text_of, with_fields
from corpusloom.llm.toxicity import Kept, held_out
from corpusloom.sources.shared import materialise

THRESHOLD = 0.7
#: Bound of what is fitted: labelled documents that teach, chosen by a hash of their id.
LABELLED_ROWS = 20_000
PLACES = 1 << 18
SHARDS, ROUNDS, PASSES = 8, 2, 3
#: FTRL-Proximal: step, its damping, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
TOKEN = re.compile(r"\w+|[^\w\s]+")
_PAIR, _SHAPES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hash(token: str) -> tuple[int, int]:
    """Hashes of the token in small letters and of its shape: capitals, small letters, digits, or the signs themselves."""
    import xxhash

    shape = "9" if token.isdigit() else token if not (token[0].isalnum() or token[0] == "_") else "A" if token.isupper() and len(token) > 1 else "a" if token.islower() else "Aa" if token.istitle() else "aA"
    return xxhash.xxh64_intdigest(token.lower()), xxhash.xxh64_intdigest(f"\0{shape}")


def vectors() -> callable:
    """From a text to the places of its n-grams, ascending, and their weights; a memory of tokens comes along."""
    kept = Kept(_hash)

    def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
        pairs = [kept[t] for t in TOKEN.findall(text)]
        if not pairs:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        both = np.array(pairs, dtype=np.uint64)
        words, shapes = both[:, 0], both[:, 1]
        grams = [words, words[:-1] * _PAIR + words[1:], shapes * _SHAPES, (shapes[:-1] * _PAIR + shapes[1:]) * _SHAPES]
        mixed = np.concatenate(grams)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        places, counts = np.unique((mixed >> np.uint64(46)).astype(np.int64), return_counts=True)
        return places, np.sqrt(counts / len(pairs))

    return vector


def teaching_rows(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """(at, target, places, weights): the vectors of at most ``most`` labelled documents outside the held-out quarter.

    Of several labels of a document the lowest counts; of several rows with its id, the one of the smallest text."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_known"), F.col("quality").alias("_quality"))
    texts = docs.select(F.col("doc_id").alias("_id"), text_of().alias("text"))
    one = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_known")).groupBy("_id").agg(F.min("text").alias("text"), F.max("_quality").cast("int").alias("target"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = vectors()
        for batch in batches:
            found = [vector(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([w for _, w in found], pa.list_(pa.float64()))], names=["at", "target", "places", "weights"]
            )

    rows = one.select(F.xxhash64("_id").alias("at"), "target", "text")
    return materialise(rows.mapInArrow(build, "at long, target int, places array<long>, weights array<double>"), "quality-teach")


class Leader:
    """The state of FTRL-Proximal; the constant is the last place and not penalised."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros(PLACES + 1) if z is None else z.copy()
        self.n = np.zeros(PLACES + 1) if n is None else n.copy()

    def weights(self, places: np.ndarray) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        free = places == PLACES
        short = np.where(free, 0.0, L1)
        w = -(z - np.sign(z) * short) / ((BETA + np.sqrt(n)) / ALPHA + np.where(free, 0.0, L2))
        return np.where(np.abs(z) <= short, 0.0, w)

    def learn(self, places: np.ndarray, values: np.ndarray, target: int) -> None:
        w = self.weights(places)
        error = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - target
        slope = error * values
        squares = self.n[places]
        self.z[places] += slope - (np.sqrt(squares + slope**2) - np.sqrt(squares)) / ALPHA * w
        self.n[places] = squares + slope**2


def learn(teaching: DataFrame) -> np.ndarray:
    """The weights by place. The driver holds the averaged state alone, two numbers a place."""
    context, z, n = teaching.sparkSession.sparkContext, None, None
    shard = F.pmod(F.col("at"), F.lit(SHARDS))
    dealt = materialise(teaching.withColumn("shard", shard).repartition(SHARDS, "shard"), "quality-dealt")

    def taught_from(begin):
        def taught(key, table):
            """A shard's rows, of which there are LABELLED_ROWS / SHARDS on average, in the order of their hashes."""
            leader = Leader(*begin.value)
            order = np.argsort(np.asarray(table["at"]), kind="stable")
            rows = [(np.append(p.as_py(), PLACES).astype(np.int64), np.append(w.as_py(), 1.0), t.as_py()) for p, w, t in ((table["places"][int(k)], table["weights"][int(k)], table["target"][int(k)]) for k in order)]
            for _ in range(PASSES):
                for places, values, target in rows:
                    leader.learn(places, values, target)
            met = np.flatnonzero(leader.n)
            return pa.table({"place": pa.array(met), "z": pa.array(leader.z[met]), "n": pa.array(leader.n[met]), "shard": pa.array(np.full(len(met), key[0].as_py()))})

        return taught

    for _ in range(ROUNDS):
        states = materialise(dealt.groupBy("shard").applyInArrow(taught_from(context.broadcast((z, n))), "place long, z double, n double, shard long"), "quality-state")
        shards = max(states.select("shard").distinct().count(), 1)
        # sums in a fixed order, so that reruns agree to the last digit
        listed = states.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("shard", "z", "n"))).alias("s"))
        total = lambda name: F.aggregate("s", F.lit(0.0), lambda a, x: a + x[name]) / shards
        mean = listed.select("place", total("z").alias("z"), total("n").alias("n")).toArrow()
        z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)
        z[np.asarray(mean["place"])], n[np.asarray(mean["place"])] = np.asarray(mean["z"]), np.asarray(mean["n"])
    return Leader(z, n).weights(np.arange(PLACES + 1))


def scored(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``_quality_score`` (0 to 1, higher: likelier good) beside their own columns.

    Null and empty texts get the score of a text without words. Rows with equal texts get equal scores. Without labels each score is one half.
    Texts of any length are read whole, one at a time. Empty tables give no rows. A column of ``docs`` named _quality_score is an error of Spark's.
    """
    bounded_batches(docs.sparkSession)
    taught = docs.sparkSession.sparkContext.broadcast(learn(teaching_rows(docs.select("doc_id", F.col(text_col).alias("text")), labels)))
    at = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, weights = vectors(), taught.value
        for batch in batches:
            sums = []
            for text in batch.column(at):
                places, values = vector(text.as_py() or "")
                sums.append(weights[places] @ values + weights[PLACES])
            chance = 1 / (1 + np.exp(-np.clip(np.array(sums, dtype=float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance)], names=[*batch.schema.names, "_quality_score"])

    return docs.mapInArrow(score, with_fields(docs, _quality_score="double"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
    return rows.select("doc_id", held_out().alias("held_out"), F.col("_quality_score").alias("score"), (F.col("_quality_score") >= THRESHOLD).cast("int").alias("predicted"))
