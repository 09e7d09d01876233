"""What the training-data operators share: materialised cuts and connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.sources.shared import materialise

#: White space of the word definitions: tab, line feeds, carriage return and blank.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of whole texts that go to a Python worker at once.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as by rows, unless the session does so itself: texts may be long, and whole partitions of them
    would otherwise stand in memory on both sides."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` as a task that gives back its memory when it ends. Spark keeps workers for later tasks, and what an idle one still
    holds is missing where a stage of the JVM comes next."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return task


def text_of(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_fields(df: DataFrame, **more: str) -> StructType:
    """The schema of ``df`` with further nullable fields."""
    out = StructType(list(df.schema.fields))
    for name, kind in more.items():
        out.add(name, kind)
    return out


def components(edges: DataFrame, tag: str = "cc", max_rounds: int = 64) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row (node, component) per node, component = smallest node.

    Each round hooks every node to its smallest neighbour, doubles those pointers until they rest, and contracts the edges, so
    the number of rounds grows with the logarithm of the size. Only pointers and contracted edges are kept, each
    as files in the shared folder; nothing but whether rows are left reaches the driver. Self loops name single nodes; nulls are ignored.
    Joins on a hot root leave the split of its rows to adaptive execution; minima combine before they shuffle.
    """
    edges = edges.where("a is not null and b is not null")
    links = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")), f"{tag}-edges")
    label = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    label = materialise(label, f"{tag}-label")
    links = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-links")
    for _ in range(max_rounds):
        if links.isEmpty():
            return label
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("child"), F.least("a", "low").alias("root"))
        hook = materialise(hook.withColumn("moved", F.lit(True)), f"{tag}-hook")
        while not hook.where("moved").isEmpty():
            up = hook.select(F.col("child").alias("root"), F.col("root").alias("above"))
            above = F.coalesce("above", "root")
            hook = hook.join(up, "root", "left").select("child", above.alias("root"), (above != F.col("root")).alias("moved"))
            hook = materialise(hook, f"{tag}-jump")
        to_a = hook.select(F.col("child").alias("a"), F.col("root").alias("ra"))
        to_b = hook.select(F.col("child").alias("b"), F.col("root").alias("rb"))
        moved = links.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        next_links = moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        next_links = materialise(next_links, f"{tag}-links")
        step = hook.select(F.col("child").alias("component"), "root")
        label = label.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        label, links = materialise(label, f"{tag}-label"), next_links
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
