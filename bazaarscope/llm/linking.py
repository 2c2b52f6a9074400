"""Confirmed links between nodes that share a bucket, without pairing a group with itself.

A node is a set of ``n`` shingles; two are linked at ``percent`` or more of Jaccard similarity, which
is a symmetric difference of at most (100 - percent) / (100 + percent) of both sizes. Its sketch is the exclusive
or of one bit per shingle, so sketches of two nodes differ in no more bits than the nodes in shingles.
Most pairs without a link are told from their sketches where they meet; no link is lost by that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

CROWD = 64  # nodes of one bucket beyond which its pairs are found otherwise
SKETCH = [f"w{i}" for i in range(16)]  # bigint columns of a sketch: 1024 bits


def shared_buckets(banded: DataFrame) -> DataFrame:
    """``(key, node)`` rows -> those of buckets with at least two rows."""
    shared = banded.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    return stored(banded.join(shared, "key"), "banded")


def _centred(banded: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows with ``n``, and the centre of their bucket with its size ``nc``: the node that shares
    most buckets, as what copies were made from does."""
    nodes = banded.groupBy("node").agg(F.count("*").alias("buckets")).join(sizes, "node")
    rows = stored(banded.join(nodes, "node"), "sized")
    best = F.max(F.struct("buckets", F.bitwise_not("node").alias("m"), F.col("n").alias("nc")))
    best = rows.groupBy("key").agg(best.alias("best"), F.min("node").alias("r0"), F.max("node").alias("r1"))
    best = best.where("r0 < r1").select("key", F.bitwise_not("best.m").alias("centre"), "best.nc")
    return stored(rows.drop("buckets").join(best, "key"), "centred")


def _spanning(keyed: DataFrame) -> DataFrame:
    """The rows of keys that span several components, with the key's number of nodes."""
    spans = keyed.groupBy("key").agg(
        F.count("*").alias("nodes"), F.min("root").alias("r0"), F.max("root").alias("r1")
    )
    return keyed.join(spans.where("r0 < r1").select("key", "nodes"), "key")


def _cross_pairs(keyed: DataFrame, percent: int) -> DataFrame:
    left, right = (
        keyed.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "n", *SKETCH)))
        for s in "ab"
    )
    bits = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in SKETCH), F.lit(0))
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = left.join(right, "key").where(
        (F.col("root_a") != F.col("root_b")) & (F.col("node_a") > F.col("node_b")) & near
        & ((100 + percent) * bits <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    )
    names = {"a": "node_a", "b": "node_b", "na": "n_a", "nb": "n_b"}
    return pairs.select(*(F.col(c).alias(name) for name, c in names.items())).distinct()


def linked(
    banded: DataFrame,
    sizes: DataFrame,
    percent: int,
    shared: Callable[[DataFrame], DataFrame],
    sketched: Callable[[DataFrame], DataFrame],
    crowded: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``(node, root)`` of all nodes with a confirmed link.

    ``banded`` comes from ``shared_buckets``, ``sizes`` holds each ``node`` and its ``n``. First every node
    is held against the centre of its buckets: one pair per row, however large the bucket. Then, where
    a bucket still spans several components, the pairs across them that sketches leave. A bucket of more
    than ``CROWD`` nodes gives them to ``crowded``, which must return keys that any two
    linked nodes share but unlike ones rarely do. ``shared`` adds to pairs ``both``, the number of common
    shingles; ``sketched`` returns one row per node with its sketch in the columns ``SKETCH``.
    """
    rows = _centred(banded, sizes)
    stars = rows.where("node <> centre").select(
        F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b"),
        F.when(F.col("node") > F.col("centre"), F.col("n")).otherwise(F.col("nc")).alias("na"),
        F.when(F.col("node") > F.col("centre"), F.col("nc")).otherwise(F.col("n")).alias("nb"),
    )
    stars = stars.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).distinct()
    stars = stored(shared(stars), "stars")

    def edges(pairs: DataFrame) -> DataFrame:
        near = (100 + percent) * F.col("both") >= percent * (F.col("na") + F.col("nb"))
        return pairs.where(near).select(F.col("a").alias("u"), F.col("b").alias("v"))

    found = components(edges(stars))

    # a bucket's centre has met all its nodes
    rooted = rows.where("node <> centre").drop("nc", "centre").join(found, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    rooted = stored(_spanning(rooted), "rooted")
    sketches = stored(sketched(rooted.select("node").distinct()), "sketches")
    pairs = _cross_pairs(rooted.where(F.col("nodes") <= CROWD).join(sketches, "node"), percent)
    crowd = stored(rooted.where(F.col("nodes") > CROWD).select("node", "root", "n").distinct(), "crowd")
    if not crowd.isEmpty():
        keyed = _spanning(crowded(crowd)).join(sketches, "node")
        pairs = pairs.unionByName(_cross_pairs(keyed, percent)).distinct()
    pairs = pairs.join(stars, ["a", "b"], "left_anti")
    # what is linked already goes in as one star for each component, which settles at once
    known = found.select(F.col("node").alias("u"), F.col("root").alias("v"))
    return components(known.unionByName(edges(shared(pairs))))
