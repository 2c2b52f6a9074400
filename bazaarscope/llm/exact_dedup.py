"""Exact dedup: frequent digests are found by Misra-Gries and removed map-side, the rest shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

COUNTERS = 1024


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _reduced(found: pd.Series, counters: int) -> pd.Series:
    """Misra-Gries: subtract the (counters + 1)-th count, keep what stays positive."""
    if len(found) > counters:
        cut = np.partition(found.to_numpy(), -counters - 1)[-counters - 1]
        found = found[found > cut] - cut
    return found


def _summarise(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pd.Series(dtype="int64")
        for batch in batches:
            frame = batch.to_pandas()
            weights = frame["n"] if "n" in frame else pd.Series(1, index=frame.index)
            held = held.add(weights.groupby(frame["digest"]).sum(), fill_value=0).astype("int64")
            held = _reduced(held, counters)
        yield pa.RecordBatch.from_pydict(
            {"digest": held.index.to_list(), "n": held.to_list()},
            schema=pa.schema([("digest", pa.string()), ("n", pa.int64())]),
        )

    return run


def heavy_candidates(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, among them each one that owns over 1/counters of all rows.

    One summary per task, merged in two steps; a summary has at most ``counters`` rows.
    """
    kind = "digest string, n long"
    parts = digests.select("digest").mapInArrow(_summarise(counters), kind)
    # a square-root tree: no task reads more than some dozens of summaries
    some = parts.repartition(16).mapInArrow(_summarise(counters), kind)
    return some.coalesce(1).mapInArrow(_summarise(counters), kind).select("digest")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after each white-space run is one space; null counts as
    empty, and all empty texts form one group. The smallest id of a group stays; rows that
    repeat it stay with it, and null ids are never chosen unless the group has no other. Only
    digests and ids are shuffled, never texts. The broadcast side has at most ``counters`` rows.
    """
    digests = texts(docs, id_col, text_col).select(
        "doc_id", F.sha2(normalised(F.col("text")), 256).alias("digest")
    )
    digests = stored(digests, "digests")  # three passes follow; texts are read once
    candidates = F.broadcast(heavy_candidates(digests, counters))
    # verification: the candidates' own counts and winners, combined map-side
    heavy = (
        digests.join(candidates, "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    marked = digests.join(F.broadcast(heavy), "digest", "left")
    done = marked.where("group_size is not null")
    light = marked.where("group_size is null").select("doc_id", "digest")
    groups = light.groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    rows = done.unionByName(light.join(groups, "digest"))
    return rows.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
  FROM documents
), g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256
FROM d JOIN g USING (h)
"""
