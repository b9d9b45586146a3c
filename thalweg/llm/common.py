"""Helpers that several training-data operators use: shared scratch tables, tokens, connected components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch tables that are still on disk, by session and by who had them written: paths under the shared folder.
_TABLES: dict[tuple[int, str], list[str]] = {}
_OWNER: ContextVar[str] = ContextVar("owner", default="")


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Scratch tables written inside belong to ``owner``."""
    was = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(was)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``, else the
    checkpoint directory of the context. Where neither is set, a session on
    one machine (as in tests) gets a temporary folder; on a cluster that is an
    error, since executors wouldn't see it.
    """
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (None if given.isEmpty() else given.get())
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="thalweg-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    if given.isEmpty():
        context.setCheckpointDir(folder)
    return folder


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back.

    A written table cuts the lineage, outlives lost executors and is computed
    once. It is needed until the results built on it have been written, so
    whoever asks for a result drops its tables with ``drop_tables``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/thalweg-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _TABLES.setdefault((id(spark.sparkContext), _OWNER.get()), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark's file systems reach."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_tables(spark: SparkSession, owner: str = "") -> None:
    """Remove the scratch tables of this session that belong to ``owner``, and no others.

    Only call it once every result built on them has been written.
    """
    for path in _TABLES.pop((id(spark.sparkContext), owner), []):
        remove(spark, path)


def drop(df: DataFrame) -> None:
    """Remove the one scratch table that ``df`` reads, once all that is built on it has been written."""
    folders = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    for paths in _TABLES.values():
        for path in [p for p in paths if p.rsplit("/", 1)[1] in folders]:
            paths.remove(path)
            remove(df.sparkSession, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; its files go when the frame does where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, else with the folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def held_out(doc_id, modulus: int, remainder: int):
    """Whether ``crc32(doc_id as text) mod modulus`` is ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)``, component the smallest member.

    Alternates large-star and small-star steps (each node points its
    neighbours at the smallest one it sees), which converge in a number of
    rounds logarithmic in the longest path. Every step is a combinable ``min``
    and an equi-join of two exchanged sides, so a hub with a large share of
    all edges is pre-aggregated and its join partition can be split. Loops and
    repeated edges are allowed; nodes without an edge don't appear.
    """
    edges = checkpointed(
        edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("lo <> hi").distinct()
        large = checkpointed(large)
        down = checkpointed(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = (
            large.join(down, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .unionByName(down.select(F.col("m").alias("lo"), "hi"))
            .where("lo <> hi").distinct()
        )
        edges = checkpointed(small)
        state = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h"),
        ).first()
        if seen == state or not state["n"]:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that no frame refers to any more, before the next large step needs the disk.

    Spark holds on to the plan of the query that ended last, so a small one is run first.
    """
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
