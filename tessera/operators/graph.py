"""Connected components of an edge table that no single machine has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import Scratch, materialize


def _larger_to_smallest(sym: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the smallest node around."""
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _smaller_to_smallest(down: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them; edges run from the larger node (u) down."""
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node that has an edge to another one; component is its smallest node.

    Alternating star contractions: logarithmically many rounds, each of equi-joins and combinable minima, cut by
    durable tables.  Edges with a null end and loops are dropped; repeated edges and either direction are fine.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter(F.col("u") != F.col("v"))
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seal = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    with Scratch(e.sparkSession) as scratch:
        e, before = scratch.table(e, "edges"), None
        while True:
            sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            star = _larger_to_smallest(sym)
            last, e = e, scratch.table(_smaller_to_smallest(star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "edges")
            scratch.drop(last)
            now = tuple(e.agg(*seal).first())
            if now == before:
                break
            before = now
        roots = e.select(F.col("v").alias("node")).distinct()
        return materialize(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))), "components")
