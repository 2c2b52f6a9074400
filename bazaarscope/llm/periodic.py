"""Periodic runs of words: maximal stretches that repeat a block of words four times or more.

Method, per chunk of about one megabyte of whole documents whose words are numbered exactly:

* Periods below ``SHORTEST_SCALE`` are scanned directly, lag by lag.
* Scale ``w`` (8, 16, 32, ...) covers the periods ``w`` to ``2w - 1``. Every run of ``2w`` words gets a
  hash; a position is selected if its hash is the least of some window of ``w`` positions. Inside a
  run of period ``q >= w`` the selection repeats every ``q`` words, and as ``2w > q`` no hash
  occurs twice within one period, so two consecutive selected positions with equal hashes lie
  exactly ``q`` apart. Such pairs are seeds; a run of four periods always has one.
* Every seed is extended word by word to the maximal stretch of its period. Only word equality
  decides; hashes only choose where to look.

A scale works on the documents that are long enough for it alone, so the work is
``n log(longest text)`` and memory is bounded by the chunk or the longest single document.

Nulls and empty texts have no words and no runs; repeated rows give one result each; rows stay in
their partition, nothing is shuffled. Other columns of the input are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .words import buffer_of, mapped, mixed, slices

LEAST_POWER, LEAST_LENGTH = 4, 6  # length >= max(LEAST_LENGTH, LEAST_POWER * period)
SHORTEST_SCALE = 8
WORD = r"[^\x20\x09-\x0D]+"
_RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{_RUN}>, collapsed string"


def _windows(values: np.ndarray, width: int, choose) -> np.ndarray:
    """``choose`` (minimum or maximum) over every window of ``width``, a power of two."""
    step = 1
    while step < width:
        values = choose(values[:-step], values[step:])
        step *= 2
    return values


def _grown(hashes: np.ndarray, step: int) -> np.ndarray:
    """Hashes of ``2 * step`` words from those of ``step`` words."""
    with np.errstate(over="ignore"):
        return mixed(hashes[:-step] * np.uint64(0x9E3779B97F4A7C15) + hashes[step:])


def _seeds(hashes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of consecutive equal minimizers, ``w`` to ``2w - 1`` apart."""
    none = np.zeros(0, np.int64)
    if len(hashes) < 2 * w:
        return none, none
    least = _windows(hashes, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    highest = _windows(np.concatenate([pad, least, pad]), w, np.maximum)
    at = np.flatnonzero(hashes == highest)
    at = at[np.argsort(hashes[at], kind="stable")]
    gap = np.diff(at)
    good = (hashes[at[1:]] == hashes[at[:-1]]) & (gap >= w) & (gap < 2 * w)
    return at[:-1][good], gap[good]


def _agree(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """From ``at`` on (backwards for step -1): how many words equal the one ``lag`` later."""
    n, size = 0, 64
    while True:
        if step > 0:
            low, high = at + n, min(at + n + size, len(words) - lag)
        else:
            low, high = max(at - n - size + 1, 0), at - n + 1
        if high <= low:
            return n
        differ = np.flatnonzero(words[low:high] != words[low + lag : high + lag])
        if len(differ):
            return n + int(differ[0] if step > 0 else high - low - 1 - differ[-1])
        n, size = n + high - low, size * 2


def _stretches(words: np.ndarray, lag: int) -> list[tuple[int, int]]:
    """Start and length of all maximal stretches of period ``lag`` that are long enough."""
    same = np.flatnonzero(words[:-lag] == words[lag:]) if len(words) > lag else []
    need = max(LEAST_LENGTH, LEAST_POWER * lag) - lag
    if len(same) < need:
        return []
    cut = np.flatnonzero(np.diff(same) != 1)
    first = same[np.concatenate([[0], cut + 1])]
    last = same[np.concatenate([cut, [len(same) - 1]])]
    long = last - first + 1 >= need
    return [(int(a), int(b - a + 1 + lag)) for a, b in zip(first[long], last[long])]


def runs_of(words: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of documents that follow each other in ``words``.

    ``words`` are exact word numbers, every document followed by a number of its own, the longest
    document first; ``lengths`` counts these separators.
    """
    found: dict[tuple[int, int], int] = {}  # the least period of a stretch is its period
    for lag in range(1, SHORTEST_SCALE):
        for stretch in _stretches(words, lag):
            found.setdefault(stretch, lag)
    ends = np.cumsum(lengths)
    hashes, width, w = mixed(words.astype(np.uint64) + np.uint64(1)), 1, SHORTEST_SCALE
    while True:
        enough = int(np.searchsorted(-lengths, -LEAST_POWER * w, "right"))
        if not enough:
            return sorted((s, n, q) for (s, n), q in found.items())
        own = words[: ends[enough - 1]]
        while width < 2 * w:
            hashes, width = _grown(hashes, width), 2 * width
        hashes = hashes[: max(len(own) - width + 1, 0)]
        at, gap = _seeds(hashes, w)
        reached: dict[int, int] = {}  # by period: where its last stretch ends
        for p, q in sorted(zip(at.tolist(), gap.tolist())):
            if p < reached.get(q, -1):
                continue
            ahead = _agree(own, p, q, 1)
            start = p - _agree(own, p - 1, q, -1)
            reached[q] = p + ahead
            length = p + ahead + q - start
            if length >= max(LEAST_LENGTH, LEAST_POWER * q):
                stretch = (start, length)
                found[stretch] = min(q, found.get(stretch, q))
        w *= 2


def _documents(column: pa.Array):
    """Per chunk: the words of each document."""
    data, offsets = buffer_of(column)
    raw = memoryview(data)
    for rows in slices(offsets):
        bounds = offsets[rows.start : rows.stop + 1]
        # bytes.split parts at exactly the white space of WORD
        yield [bytes(raw[a:b]).split() for a, b in zip(bounds[:-1], bounds[1:])]


def _chunk_runs(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    numbers: dict[bytes, int] = {}
    parts, separator = [], itertools.count(-1, -1)
    for i in order:
        parts.append([numbers.setdefault(w, len(numbers)) for w in docs[i]])
        parts.append([next(separator)])
    words = np.fromiter(itertools.chain.from_iterable(parts), np.int64)
    lengths = np.array([len(docs[i]) + 1 for i in order])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out: list[list] = [[] for _ in docs]
    for start, length, period in runs_of(words, lengths):
        k = int(np.searchsorted(starts, start, "right")) - 1
        out[order[k]].append((start - int(starts[k]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    dropped = bytearray(len(words))
    for start, length, period in runs:
        dropped[start + period : start + length] = b"\1" * (length - period)
    return b" ".join(w for w, gone in zip(words, dropped) if not gone)


def _found(batch: pa.RecordBatch):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
            ("collapsed", pa.string()),
        ]
    )
    at = 0
    for docs in _documents(batch.column("text")):
        runs = _chunk_runs(docs)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").slice(at, len(docs)),
                pa.array([len(d) for d in docs], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs],
                         schema.field("runs").type),
                pa.array([collapsed(d, r) for d, r in zip(docs, runs)], pa.binary()).cast(pa.string()),
            ],
            schema=schema,
        )
        at += len(docs)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` per row of ``docs``: all runs by start and period,
    and the text without their repetitions, its words joined by one space."""
    return texts(docs).mapInArrow(mapped(_found), SCHEMA)


def _with_repeats(doc_id: Column, text: Column) -> Column:
    """The text whose tail repeats: for a tenth of all ids, word ``i >= a`` becomes word
    ``a + (i - a) % p``. Rows without an id are left alone."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def damaged(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(
            F.sequence(F.lit(0), n - a - 1), lambda i: F.element_at(words, (a + i % p + 1).cast("int"))
        )
        return F.array_join(F.concat(F.slice(words, 1, a), tail), " ")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    hit = (h % 10 == 0) & text.rlike(WORD)
    return F.when(hit, F.element_at(F.transform(F.array(words), damaged), 1)).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """The runs of all documents after the damage of the contract, as counts and digests."""
    rows = texts(docs)
    rows = rows.select("doc_id", _with_repeats(rows["doc_id"], rows["text"]).alias("text"))
    rows = periodic_runs(rows)
    rank = F.transform(
        "runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"].alias("at"),
                                   r["period"].alias("period"))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(rank)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["at"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(
            F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256
        ).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
