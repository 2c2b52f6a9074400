"""Distributed union-find over an edge table with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

_MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.col("u") != F.col("v")).cast("int"))
    ).first()
    return tuple(row)


def _with_minimum(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(lowest, "u").withColumn("m", F.least("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` pairs of bigint nodes -> ``(node, root)``, root the smallest reachable node.

    Alternates the large-star and small-star steps: every round links a node's larger (then its
    smaller) neighbours to the smallest one, until nothing changes; the rounds grow with the
    logarithm of the longest chain. A node with very many neighbours is reduced map-side for its
    minimum and its rows are split by the skew join. Rounds are written to the shared folder.
    Self links and repeated links are harmless; nodes without links are not returned; an empty
    table gives an empty one.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = stored(edges.where("u <> v").distinct(), "edges")
    before = _state(edges)
    for _ in range(_MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        kept = _with_minimum(large)
        small = kept.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            kept.select("u", F.col("m").alias("v"))
        )
        edges = stored(small.where("u <> v").distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("union-find did not settle")
    rows = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rows.unionByName(rows.select(F.col("root").alias("node"), "root").distinct())
