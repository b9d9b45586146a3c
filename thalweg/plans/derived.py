"""Networks, lines, points and flows derived from the shared tables, so that every operator has a query over real rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.operators import trees
from thalweg.operators.network import Network
from thalweg.operators.trees import checkpointed


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heap_x(k: Column) -> tuple[Column, Column]:
    """Level of a heap node and its exact dyadic x: (k - 2^level + 0.5) / 2^level."""
    level = F.length(F.bin(k)) - 1
    width = F.pow(F.lit(2.0), level)
    return level, (k.cast("double") - width + 0.5) / width


def part_heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``segnum, to_segnum, pos, value``: segment k flows to k div 2; the root is 1."""
    return read(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1).alias("segnum"), F.expr("(p_partkey + 1) div 2").alias("to_segnum"), F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("value")
    )


def supplier_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One heap per nation over suppliers in key order: several outlets (``to_segnum`` 0)."""
    from pyspark.sql import Window

    ranked = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).alias("segnum"), "s_nationkey", F.col("s_suppkey").alias("pos"), F.col("s_acctbal").alias("value")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("segnum")).cast("long")
    )
    up = ranked.select("s_nationkey", F.col("rank").alias("half"), F.col("segnum").alias("to_segnum"))
    return ranked.withColumn("half", F.expr("rank div 2")).join(up, ["s_nationkey", "half"], "left").select("segnum", F.coalesce("to_segnum", F.lit(0).cast("long")).alias("to_segnum"), "pos", "value")


def part_comb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deep irregular forest: segment k flows to max(k - 1 - k * 7919 % 8, 0)."""
    return read(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("segnum"), F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("value")).withColumn(
        "to_segnum", F.greatest(F.col("segnum") - 1 - (F.col("segnum") * 7919) % 8, F.lit(0).cast("long"))
    )


def supplier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``segnum, pos, geometry``: heap lines over suppliers, each from its node to its parent's, every vertex a dyadic number."""
    keys = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).alias("segnum"), F.col("s_suppkey").alias("pos"))
    level, x = heap_x(F.col("segnum"))
    up_level, up_x = heap_x(F.expr("segnum div 2"))
    # The root ends below level 0.
    end_x, end_y = F.when(F.col("segnum") == 1, 0.5).otherwise(up_x), F.when(F.col("segnum") == 1, -1).otherwise(up_level)
    line = F.array(G.xyz(x, level, None), G.xyz((x + end_x) / 2, (level + end_y) / 2 + 0.125, None), G.xyz(end_x, end_y, None))
    return keys.select("segnum", "pos", line.alias("geometry"))


def supplier_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``segnum, rings``: a box per supplier node, as wide as its place on the level."""
    keys = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).alias("segnum"))
    level, x = heap_x(F.col("segnum"))
    half = 0.5 / F.pow(F.lit(2.0), level)
    corner = lambda a, b: G.xyz(x + a * half, level + b, None)
    return keys.select("segnum", F.array(F.array(corner(-1, -0.5), corner(1, -0.5), corner(1, 0.5), corner(-1, 0.5), corner(-1, -0.5))).alias("rings"))


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``loc, x, y``: points spread over the lines by multiplying keys, in 64ths so that all are exact."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("loc"), ((k * 7919) % 64).cast("double").alias("u"), ((k * 104729) % 512).cast("double").alias("v")).select(
        "loc", (F.col("u") / 64 + F.lit(1 / 256)).alias("x"), (F.col("v") / 64 - 1).alias("y")
    )


def network_of(edges: DataFrame, *, with_orders: bool = True, length: str | None = None) -> Network:
    """A network of ``edges(segnum, to_segnum, pos, value)`` without lines."""
    up = checkpointed(trees.climb(edges, 0, length=length))
    full = edges.join(up, "segnum").join(trees.from_segnums(edges, 0), "segnum")
    if with_orders:
        full = full.join(trees.orders(edges.select("segnum", "pos", "to_segnum").join(up, "segnum"), 0), "segnum")
    return Network(checkpointed(full), 0)


def monthly_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``month, segnum, flow``: quantities shipped, by month and part."""
    return read(spark, sf_dir, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").alias("month"), (F.col("l_partkey") + 1).alias("segnum")).agg(F.sum("l_quantity").alias("flow"))
