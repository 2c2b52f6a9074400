"""Near-duplicate documents by min-max MinHash, confirmed on full shingle sets.

Each permutation keeps its minimum and its maximum, so 288 signature values cost 144 hash
evaluations per shingle. Bands of six values are the candidate keys: a pair at similarity 0.75
shares one of 48 bands with probability 1 - 8e-5, at 0.8 with 1 - 5e-7, and texts that only share
a passage rarely do. That holds for large sets: minimum and maximum of one permutation are not
independent in small ones, and 3 of 4 shingles are missed with 1.6e-3, 6 of 8 with 3e-4. Equal sets are one node from the start. Links
are confirmed in two steps: every node of a bucket against the bucket's centre, then only pairs of
one bucket that still lie in different components and whose sketches may be a link's. The second
step never expands a group of copies, as these are one component by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, stored, texts
from .linking import SKETCH, linked, shared_buckets
from .words import Chunk, chunks, mapped, mixed, ranged, signed

WIDTH = 5
PERCENT = 75  # least similarity of a link, in hundredths
PERMUTATIONS = 144
BAND_ROWS = 6

_rng = np.random.Generator(np.random.PCG64(97))
_XOR = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(chunk: Chunk, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle ids by document, concatenated in ascending order, and their bounds.

    A document of fewer words is one shingle, without words it is empty.
    """
    at, ids = chunk.shingles(width)
    document = chunk.document_of_words()[at]
    n = chunk.n_words
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = mixed(ranged(chunk.ids, chunk.first[short], chunk.first[short + 1]))
        ids, document = np.append(ids, whole), np.append(document, short)
    order = np.lexsort((ids, document))
    ids, document = ids[order], document[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (document[1:] != document[:-1])
    ids, document = ids[fresh], document[fresh]
    return ids, np.searchsorted(document, np.arange(chunk.count + 1))


def signatures(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation for the non-empty sets, as columns."""
    starts = bounds[:-1][bounds[1:] > bounds[:-1]]
    out = np.zeros((len(starts), 2 * PERMUTATIONS), np.uint64)
    if len(starts):
        with np.errstate(over="ignore"):
            for p in range(PERMUTATIONS):
                moved = (ids ^ _XOR[p]) * _TIMES[p]
                out[:, 2 * p] = np.minimum.reduceat(moved, starts)
                out[:, 2 * p + 1] = np.maximum.reduceat(moved, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row; the band's number is part of the key."""
    n = signature.shape[1] // BAND_ROWS
    keys = np.zeros((len(signature), n), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(n):
            key = np.full(len(signature), band, np.uint64)
            for r in range(BAND_ROWS):
                key = mixed(key * np.uint64(31) + signature[:, band * BAND_ROWS + r])
            keys[:, band] = key
    return keys


def sketches(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The exclusive or of one bit per shingle, a row of words for each set."""
    n, width = len(bounds) - 1, 64 * len(SKETCH)
    at = np.repeat(np.arange(n), np.diff(bounds)) * width + (ids % np.uint64(width)).astype(np.int64)
    odd = np.bincount(at, minlength=n * width) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, width), axis=1).view(np.int64)


def _signed_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batch.column("text"), fold=True):
        ids, bounds = shingle_sets(chunk)
        n = np.diff(bounds)
        full = n > 0
        marks = np.zeros((2, chunk.count), np.uint64)
        starts = bounds[:-1][full]
        if len(starts):
            marks[0, full] = np.add.reduceat(mixed(ids), starts)
            marks[1, full] = np.add.reduceat(mixed(ids ^ np.uint64(0x5851F42D4C957F2D)), starts)
        keys = band_keys(signatures(ids, bounds))
        sketch = sketches(ids, bounds)
        bands = np.zeros(chunk.count + 1, np.int32)
        np.cumsum(full * keys.shape[1], out=bands[1:])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").slice(chunk.rows.start, chunk.count), pa.array(n, pa.int64()),
             pa.array(signed(marks[0])), pa.array(signed(marks[1])),
             pa.ListArray.from_arrays(pa.array(bands), pa.array(signed(keys.ravel()))),
             *(pa.array(sketch[:, i]) for i in range(len(SKETCH)))],
            names=["doc_id", "n_shingles", "s1", "s2", "bands", *SKETCH],
        )


def _common(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    both = np.zeros(batch.num_rows, np.int64)
    sides = [iter(chunks(batch.column(c), fold=True)) for c in ("text_a", "text_b")]
    held: list = [None, None]
    for i in range(batch.num_rows):
        sets = []
        for side in (0, 1):
            while held[side] is None or i >= held[side][0].rows.stop:
                chunk = next(sides[side])
                held[side] = (chunk, *shingle_sets(chunk))
            chunk, ids, bounds = held[side]
            at = i - chunk.rows.start
            sets.append(ids[bounds[at] : bounds[at + 1]])
        both[i] = len(np.intersect1d(*sets, assume_unique=True))
    names = ["a", "b", "na", "nb"]
    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(both)], names=[*names, "both"])


def shared(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``(a, b, na, nb)`` with ``both``, the size of the intersection of their full sets. Only
    texts of paired nodes move."""
    nodes = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    wanted = rows.join(nodes, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    first = wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    second = wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(first, "b").join(second, "a")
    both = both.select("a", "b", "na", "nb", "text_a", "text_b")
    return both.mapInArrow(mapped(_common), "a long, b long, na long, nb long, both long")


def _rare_keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Shingles of a text by id; joined with their counts they give the rarest ones."""
    for chunk in chunks(batch.column("text"), fold=True):
        ids, bounds = shingle_sets(chunk)
        document = batch.column("doc_id").to_numpy()[chunk.rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(document, np.diff(bounds))), pa.array(signed(ids))],
            names=["node", "shingle"],
        )


def _rarest(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``nodes`` with the keys of prefix filtering.

    Two sets at the similarity share one of the rarest (100 - PERCENT) % + 1 shingles of either,
    so passages that many documents share, being the most frequent, never join them.
    """
    wanted = rows.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    each = wanted.dropDuplicates(["doc_id"]).mapInArrow(mapped(_rare_keys), "node long, shingle long")
    each = stored(each, "shingles")
    counts = each.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1")
    # a shingle of one node joins nothing; it still takes its place among the rarest
    ranked = (
        each.join(counts, "shingle", "left")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "shingle"))).alias("s"))
    )
    take = F.size("s") - F.ceil(F.size("s") * PERCENT / 100).cast("int") + 1
    prefix = ranked.select("node", F.explode(F.slice("s", F.lit(1), take)).alias("x"))
    prefix = prefix.where("x.c > 1").select("node", F.col("x.shingle").alias("key"))
    return prefix.join(nodes, "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are A-Z lower-cased; a set holds the distinct five-word shingles, or the whole sequence
    of a shorter text. Null texts and texts without words have an empty set and stand alone. Rows
    that repeat an id are one node of the graph but keep their own rows; rows with a null id are
    left out. Links: 100 * intersection >= 75 * union, confirmed on full sets.
    """
    prepared(docs.sparkSession)
    rows = texts(docs, id_col, text_col).where("doc_id is not null")
    kind = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
    kind += "".join(f", {w} long" for w in SKETCH)
    signed_rows = stored(rows.mapInArrow(mapped(_signed_rows), kind), "signatures")

    sets = signed_rows.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"))
    sets = stored(sets, "sets")
    nodes = signed_rows.where("n_shingles > 0").join(
        sets, [signed_rows.doc_id == sets.node, signed_rows.s1 == sets.s1, signed_rows.s2 == sets.s2],
        "left_semi",
    ).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands")
    sizes = stored(nodes.groupBy("node").agg(F.max("n").alias("n")), "sizes")
    banded = shared_buckets(nodes.select("node", F.explode("bands").alias("key")))

    sketched = signed_rows.select(F.col("doc_id").alias("node"), *SKETCH)
    final = linked(
        banded, sizes, PERCENT, lambda pairs: shared(pairs, rows),
        lambda nodes: sketched.join(nodes, "node", "left_semi").dropDuplicates(["node"]),
        lambda crowd: _rarest(crowd, rows),
    )
    labelled = sets.join(final, "node", "left").select(
        "s1", "s2", F.coalesce("root", "node").alias("component_id")
    )
    named = signed_rows.drop("bands", *SKETCH).join(labelled, ["s1", "s2"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return named.withColumn("kept", F.col("doc_id") == F.col("component_id"))
