"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping blocks of five words, and blocks are indexed; rolling
five-word windows probe them. A repeat of 50 words holds nine whole consecutive blocks of either
document, so of each nine consecutive blocks only the one with the least hash is indexed, and only
rolling windows that are least among nine in steps of five probe: nothing is lost and four fifths
of the probes stay at home. Hits are extended to exact repeats: the 50-word windows around a hit
block are compared by id with those of all other documents, and adjacent confirmed windows join
to maximal spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, texts
from .words import Chunk, chunks, mapped, mixed, ranged, signed

WINDOW = 50
BLOCK = 5
RUN = (WINDOW - BLOCK + 1) // BLOCK  # whole blocks in any window, wherever it begins
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_FLUSH = 1 << 20


def selected(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a probing window begins, and the windows' ids."""
    n = len(chunk.ids)
    at, ids = chunk.shingles(BLOCK)
    grams = np.full(n, _NONE)
    grams[at] = ids
    least = grams.copy()
    for j in range(1, RUN):
        np.minimum(least[: n - BLOCK * j], grams[BLOCK * j :], out=least[: n - BLOCK * j])
    ends = np.repeat(chunk.first[1:], chunk.n_words)
    whole = np.arange(n) + BLOCK * RUN <= ends
    chosen = np.zeros(n, bool)
    for j in range(RUN):
        chosen[BLOCK * j :] |= whole[: n - BLOCK * j] & (least[: n - BLOCK * j] == grams[BLOCK * j :])
    at = np.flatnonzero(chosen)
    return at, grams[at]


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of probing windows with the least and greatest document, combined map-side."""
    ids: list[np.ndarray] = []
    documents: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        h, d = np.concatenate(ids), np.concatenate(documents)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        h, low, high = h[starts], np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
        order = np.argsort(low, kind="stable")  # equal neighbours compress in the shuffle
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(h[order])), pa.array(low[order]), pa.array(high[order])],
            names=["h", "low", "high"],
        )

    for batch in batches:
        names = batch.column("doc_id").to_numpy()
        for chunk in chunks(batch.column("text")):
            at, h = selected(chunk)
            ids.append(h)
            documents.append(names[chunk.rows][chunk.document_of_words()[at]])
            held += len(h)
            if held >= _FLUSH:
                yield flush()
                ids, documents, held = [], [], 0
    if held:
        yield flush()


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    names = batch.column("doc_id").to_numpy()
    for chunk in chunks(batch.column("text")):
        at, h = selected(chunk)
        document = chunk.document_of_words()[at]
        place = at - chunk.first[document]
        own = place % BLOCK == 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(h[own])), pa.array(names[chunk.rows][document[own]]),
             pa.array(place[own].astype(np.int32))],
            names=["h", "doc_id", "at"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate windows around hit blocks. Of equal windows in one batch only those of the
    smallest document are asked about; the others are settled here and leave as runs."""
    for batch in batches:
        names = batch.column("doc_id").fill_null(0).to_numpy()  # without an id there are no hits
        hits = batch.column("hits")
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for chunk in chunks(batch.column("text")):
            mine = hits.slice(chunk.rows.start, chunk.count)
            bounds = mine.offsets.to_numpy() - mine.offsets[0].as_py()
            document = np.repeat(np.arange(chunk.count), np.diff(bounds))
            hit = chunk.first[document] + mine.flatten().to_numpy()
            n = len(chunk.ids)
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, np.maximum(hit - (WINDOW - BLOCK), chunk.first[document]), 1)
            np.add.at(edge, np.minimum(hit + 1, n), -1)
            ends = np.repeat(chunk.first[1:], chunk.n_words)
            at = np.flatnonzero((np.cumsum(edge)[:n] > 0) & (np.arange(n) + WINDOW <= ends))
            document = chunk.document_of_words()[at]
            h = mixed(ranged(chunk.ids, at, at + WINDOW) + np.uint64(WINDOW))
            held.append((h, names[chunk.rows][document], at - chunk.first[document]))
        if not held:
            continue
        h, d, p = (np.concatenate(x) for x in zip(*held))
        if not len(h):
            continue
        order = np.lexsort((d, h))
        h, d, p = h[order], d[order], p[order]
        fresh = np.append(True, h[1:] != h[:-1])
        least = d[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        asked = d == least
        low, high, of = _runs(d[~asked], p[~asked])
        h, d, p = h[asked], d[asked], p[asked]
        order = np.lexsort((p, d))  # equal neighbours compress in the shuffle
        h, d, p = h[order], d[order], p[order]
        key = mixed(of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + low.astype(np.uint64))
        # the two columns that differ from the row before stand side by side, the others repeat it:
        # the shuffle's compression then writes a row as these two alone
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(np.append(h, key))), pa.array(np.append(p, low).astype(np.int32)),
             pa.array(np.append(d, of)),
             pa.array(np.append(np.zeros(len(h), np.int32), (high - low).astype(np.int32))),
             pa.array(np.append(np.zeros(len(h), bool), np.ones(len(low), bool)))],
            names=["h", "low", "doc_id", "more", "settled"],
        )


def _runs(d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive positions by document."""
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    if not len(d):
        return p, p, d
    cut = np.append(True, (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1))
    starts = np.flatnonzero(cut)
    return p[starts], p[np.append(starts[1:] - 1, len(p) - 1)], d[starts]


def repeated_windows(rows: DataFrame) -> DataFrame:
    """``doc_id, spans``: runs ``(low, high)`` of window starts that repeat an earlier document."""
    known = rows.where("doc_id is not null and text is not null")
    probes = known.mapInArrow(_probes, "h long, low long, high long")
    shared = probes.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    shared = shared.where("low < high").select("h")
    blocks = known.mapInArrow(mapped(_blocks), "h long, doc_id long, at int")
    hits = blocks.join(shared, "h").groupBy("doc_id").agg(F.collect_set("at").alias("hits"))
    # a left join of all rows, as the result needs: the texts are shuffled once for both
    windows = rows.join(hits, "doc_id", "left").select("doc_id", "text", "hits").mapInArrow(
        _windows, "h long, low int, doc_id long, more int, settled boolean"
    )
    # one row per window and batch, so a passage of very many documents stays a small partition
    first = F.min("doc_id").over(Window.partitionBy("h"))
    covered = windows.withColumn("first", first).where("settled or first < doc_id")
    run = F.struct("low", (F.col("low") + F.col("more")).alias("high"))
    return covered.groupBy("doc_id").agg(F.collect_list(run).alias("spans"))


def _cleaned(batch: pa.RecordBatch, with_text: bool) -> Iterator[pa.RecordBatch]:
    spans = batch.column("spans").to_pylist()
    for chunk in chunks(batch.column("text")):
        n = len(chunk.ids)
        edge = np.zeros(n + 1, np.int64)
        for d in range(chunk.count):
            own = spans[chunk.rows.start + d]
            if own:
                base, end = chunk.first[d], chunk.first[d + 1]
                for run in own:
                    edge[base + run["low"]] += 1
                    edge[min(base + run["high"] + WINDOW, end)] -= 1
        kept = np.cumsum(edge)[:n] <= 0
        document = chunk.document_of_words()
        removed = np.bincount(document[~kept], minlength=chunk.count)
        texts_left = _joined(chunk, kept, document)
        columns = [
            batch.column("doc_id").slice(chunk.rows.start, chunk.count),
            pa.array(chunk.n_words, pa.int64()), pa.array(removed, pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts_left], pa.string()),
        ]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns, names = [*columns, pa.array([t.decode() for t in texts_left])], [*names, "text"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _joined(chunk: Chunk, kept: np.ndarray, document: np.ndarray) -> list[bytes]:
    """The kept words of each document joined by one space."""
    at = np.flatnonzero(kept)
    inside = np.zeros(len(chunk.data) + 1, np.int32)
    np.add.at(inside, chunk.starts[at], 1)
    np.add.at(inside, chunk.ends[at], -1)
    mask = np.cumsum(inside)[:-1] > 0
    # the byte after a kept word stands for the space before the document's next kept word
    follows = at[:-1][document[at[:-1]] == document[at[1:]]] if len(at) else at
    gaps = chunk.ends[follows]
    data = chunk.data.copy()
    data[gaps] = 32
    mask[gaps] = True
    sums = np.append(0, np.cumsum(mask))
    out = data[mask].tobytes()
    bounds = sums[chunk.offsets].tolist()
    return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept
    ``text``.

    Words are runs of non-space bytes, unchanged. Null texts have no words. Texts under 50 words
    keep them all. Rows that share an id are taken to hold the same text and never remove each
    other's words; rows with a null id keep all theirs.
    """
    prepared(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    spans = repeated_windows(rows)
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    joined = rows.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(
        mapped(lambda batch: _cleaned(batch, with_text)), kind + (", text string" if with_text else "")
    )
