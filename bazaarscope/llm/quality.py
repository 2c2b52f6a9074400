"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its potential is a sum of weights of binned line features, its own and
those of its two neighbours, plus a weight for each transition. Forward-backward marginals,
weighted by line length, make the document's quality, which a logistic curve turns into the
probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, prepared, texts
from .words import Chunk, chunks, mapped, ranged

PER_LABEL = 1500  # labelled documents of each label that the fit reads
_ROUNDS = 150
_RATE = 0.08
_RIDGE = 1e-3

# upper bounds of the bins of each line feature; values above the last bound share a bin
_EDGES = {
    "length": (0, 8, 16, 32, 64, 128, 256, 512, 1024),
    "words": (0, 1, 2, 4, 8, 16, 32, 64),
    "word_length": (2, 3, 4, 5, 6, 7, 9, 12),
    "upper": (0.0, 0.02, 0.05, 0.1, 0.3, 0.6),
    "digits": (0.0, 0.02, 0.1, 0.3),
    "marks": (0.0, 0.01, 0.03, 0.06, 0.1, 0.2),
    "symbols": (0.0, 0.01, 0.03, 0.06, 0.12, 0.25),
    "beyond_ascii": (0.0, 0.02, 0.08, 0.2),
    "distinct": (0.2, 0.4, 0.6, 0.75, 0.9, 0.99),
    "repeats": (1, 2, 3, 5),
    "like_before": (0,),
    "ended": (0,),
}
_NAMES = list(_EDGES)
_BASES = np.cumsum([0, *(len(e) + 1 for e in _EDGES.values())])
BINS = int(_BASES[-1])

_CLASS = np.full(256, 4, np.int64)  # 0 lower, 1 upper, 2 digit, 3 mark, 4 symbol, 5 beyond, 6 space
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[192:256] = 0, 1, 2, 5
_CLASS[128:192] = 7  # continuation bytes
_CLASS[list(b".,;:!?'\"()-")] = 3
_CLASS[[0x20, *range(9, 14)]] = 6


@dataclass
class Lines:
    """Feature bins (one row per line), byte lengths and the first line of each document."""

    bins: np.ndarray
    lengths: np.ndarray
    first: np.ndarray


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def lines_of(chunk: Chunk) -> Lines:
    """The lines of a chunk; an empty document has one empty line."""
    data, offsets = chunk.data, chunk.offsets
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    first = np.searchsorted(feeds, offsets) + np.arange(len(offsets))
    n = len(starts)
    ends = np.empty(n, np.int64)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offsets[1:]
    lengths = ends - starts
    document = np.repeat(np.arange(chunk.count), np.diff(first))

    kinds = _CLASS[data]
    counts = np.zeros((8, n))
    for k in (0, 1, 2, 3, 4, 5, 6):
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kinds == k, out=sums[1:])
        counts[k] = sums[ends] - sums[starts]
    letters = counts[0] + counts[1] + counts[5]
    visible = counts[:6].sum(axis=0)

    # a line holds the words that start in it
    line_of_word = np.searchsorted(starts, chunk.starts, "right") - 1
    words = np.bincount(line_of_word, minlength=n)
    order = np.lexsort((chunk.ids, line_of_word))
    w, at = chunk.ids[order], line_of_word[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (at[1:] != at[:-1])
    distinct = np.bincount(at[fresh], minlength=n)

    marks = ranged(data.astype(np.uint64) + np.uint64(1), starts, ends)
    order = np.lexsort((marks, document))
    same = np.ones(n, bool)
    same[1:] = (marks[order][1:] != marks[order][:-1]) | (document[order][1:] != document[order][:-1])
    group = np.cumsum(same) - 1
    repeats = np.empty(n, np.int64)
    repeats[order] = np.bincount(group)[group] if n else 0
    like_before = np.zeros(n, bool)
    like_before[1:] = (marks[1:] == marks[:-1]) & (document[1:] == document[:-1])
    padded = np.append(data, 0)
    last = padded[np.maximum(ends - 1, 0)]
    ended = (lengths > 0) & np.isin(last, np.frombuffer(b".!?", np.uint8))

    values = {
        "length": lengths, "words": words, "word_length": _share(visible, words),
        "upper": _share(counts[1], letters), "digits": _share(counts[2], visible),
        "marks": _share(counts[3], visible), "symbols": _share(counts[4], visible),
        "beyond_ascii": _share(counts[5], visible), "distinct": _share(distinct, words),
        "repeats": repeats, "like_before": like_before, "ended": ended,
    }
    bins = np.empty((n, len(_NAMES)), np.int64)
    for f, name in enumerate(_NAMES):
        bins[:, f] = _BASES[f] + np.searchsorted(_EDGES[name], values[name], "left")
    return Lines(bins, lengths, first)


@dataclass
class Field:
    """Weights in favour of good: own, previous and next line's bins; bias; transitions."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    steps: np.ndarray  # steps[i, j] for state i followed by j; 0 bad, 1 good
    slope: float = 1.0
    offset: float = 0.0

    def potentials(self, lines: Lines) -> np.ndarray:
        n = len(lines.bins)
        out = self.own[lines.bins].sum(axis=1) + self.bias
        inner = np.ones(n, bool)
        inner[lines.first[:-1]] = False
        at = np.flatnonzero(inner)
        out[at] += self.before[lines.bins[at - 1]].sum(axis=1)
        out[at - 1] += self.after[lines.bins[at]].sum(axis=1)
        return out

    def marginals(self, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and summed P of each transition."""
        good = self.potentials(lines)
        return forward_backward(good, self.steps, lines.first)

    def quality(self, lines: Lines, marginals: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each document; an empty line weighs as one byte."""
        weight = lines.lengths + 1.0
        sums = np.add.reduceat(np.column_stack([weight * marginals, weight]), lines.first[:-1])
        return sums[:, 0] / sums[:, 1]

    def score(self, quality: np.ndarray) -> np.ndarray:
        odds = self.slope * _logit(quality) + self.offset
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def forward_backward(good, steps, first) -> tuple[np.ndarray, np.ndarray]:
    """All chains at once: position by position over the chains that are that long."""
    n_lines = np.diff(first)
    order = np.argsort(-n_lines, kind="stable")
    heads, sizes = first[:-1][order], n_lines[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    unary = np.column_stack([np.zeros(len(good)), good])
    forward, backward = np.zeros_like(unary), np.zeros_like(unary)
    for t in range(longest):
        at = heads[: active[t]] + t
        forward[at] = unary[at]
        if t:
            prior = forward[at - 1]
            forward[at] += np.logaddexp(prior[:, :1] + steps[0], prior[:, 1:] + steps[1])
    for t in range(longest - 2, -1, -1):
        at = heads[: active[t + 1]] + t
        later = backward[at + 1] + unary[at + 1]
        backward[at] = np.logaddexp(steps[:, 0] + later[:, :1], steps[:, 1] + later[:, 1:])
    both = forward + backward
    p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))
    inner = np.ones(len(good), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    total = np.logaddexp(both[at, 0], both[at, 1])
    moves = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            moves[i, j] = np.exp(forward[at - 1, i] + steps[i, j] + unary[at, j] + backward[at, j] - total).sum()
    return p, moves


def _ascend(lines: Lines, labels: np.ndarray, chain: bool) -> Field:
    """Maximum likelihood by Adam; without ``chain`` the lines are independent."""
    n = len(lines.bins)
    inner = np.ones(n, bool)
    inner[lines.first[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), 1)
    size = 3 * BINS + 5
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for r in range(1, _ROUNDS + 1):
        field = _field(theta, chain)
        p, moves = field.marginals(lines)
        miss = labels - p
        grad = np.zeros(size)
        for f in range(lines.bins.shape[1]):
            grad[:BINS] += np.bincount(lines.bins[:, f], miss, BINS)
            if chain:
                grad[BINS : 2 * BINS] += np.bincount(lines.bins[at - 1, f], miss[at], BINS)
                grad[2 * BINS : 3 * BINS] += np.bincount(lines.bins[at, f], miss[at - 1], BINS)
        grad[3 * BINS] = miss.sum()
        if chain:
            grad[3 * BINS + 1 :] = (seen - moves).ravel()
        grad = grad / n - _RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + _RATE * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return _field(theta, chain)


def _field(theta: np.ndarray, chain: bool) -> Field:
    steps = theta[3 * BINS + 1 :].reshape(2, 2) if chain else np.zeros((2, 2))
    return Field(theta[:BINS], theta[BINS : 2 * BINS], theta[2 * BINS : 3 * BINS], theta[3 * BINS], steps)


def fit_lines(lines: Lines, quality: np.ndarray) -> Field:
    """From documents' labels: a first pass over single lines tells which lines of the bad
    documents are bad, the field is fitted to those, then the curve to the documents."""
    document = np.repeat(np.arange(len(quality)), np.diff(lines.first))
    labels = quality[document].astype(np.int64)
    # the two kinds of lines count alike in the first pass
    alone = _ascend(lines, labels, chain=False)
    p, _ = alone.marginals(lines)
    prior = np.clip(labels.mean(), 0.01, 0.99)
    worst = np.minimum.reduceat(p, lines.first[:-1])
    looks_good = (p > prior) & (p > worst[document])
    labels = np.where((labels == 0) & looks_good, 1, labels)
    field = _ascend(lines, labels, chain=True)
    marginals, _ = field.marginals(lines)
    x = _logit(field.quality(lines, marginals))
    slope, offset = 1.0, 0.0
    for _ in range(400):
        odds = np.clip(slope * x + offset, -40, 40)
        miss = quality - 1 / (1 + np.exp(-odds))
        slope += 0.05 * float((miss * x).mean())
        offset += 0.2 * float(miss.mean())
    field.slope, field.offset = max(slope, 0.05), offset
    return field


def _sampled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batch.column("text")):
        lines = lines_of(chunk)
        bins, lengths = [], []
        for lo, hi in zip(lines.first[:-1], lines.first[1:]):
            bins.append(lines.bins[lo:hi].astype(np.uint8).tobytes())
            lengths.append(lines.lengths[lo:hi].astype("<i8").tobytes())
        rows = (chunk.rows.start, chunk.count)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").slice(*rows), batch.column("label").slice(*rows),
             pa.array(bins, pa.binary()), pa.array(lengths, pa.binary())],
            names=["doc_id", "label", "bins", "lengths"],
        )


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Field | None:
    """Fit on at most ``per_label`` documents of each label, the first by a hash of the id; the
    bounded sample of ids is broadcast. A document with several labels counts as 0 if any of them
    is. None without documents of both labels."""
    known = labels.where("doc_id is not null and quality is not null")
    known = known.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("label")
    ).groupBy("doc_id").agg(F.min("label").alias("label"))
    draw = F.xxhash64("doc_id")
    parts = [known.where(F.col("label") == x).orderBy(draw, "doc_id").limit(per_label) for x in (0, 1)]
    sample = texts(docs).join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    rows = sample.select("doc_id", "label", "text").mapInArrow(
        mapped(_sampled), "doc_id long, label int, bins binary, lengths binary"
    ).toPandas()
    if rows["label"].nunique() < 2:
        return None
    rows = rows.sort_values("doc_id", kind="stable")
    bins = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(-1, len(_NAMES)).astype(np.int64)
    lengths = np.frombuffer(b"".join(rows["lengths"]), "<i8")
    counts = np.array([len(x) // 8 for x in rows["lengths"]])
    return fit_lines(
        Lines(bins, lengths, np.concatenate([[0], np.cumsum(counts)])),
        rows["label"].to_numpy().astype(float),
    )


def scored(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, score, n_lines, bad_lines (positions of the lines labelled bad) of every row.

    Map-only. Null texts count as empty, an empty text is one empty line; repeated rows are
    scored each for itself and null ids pass through. Without a fitted field every score is 0.5.
    """
    prepared(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batch.column("text")):
            lines = lines_of(chunk)
            if field is None:
                score, p = np.full(chunk.count, 0.5), np.full(len(lines.bins), 0.5)
            else:
                p, _ = field.marginals(lines)
                score = field.score(field.quality(lines, p))
            bad = np.flatnonzero(p < 0.5)
            document = np.searchsorted(lines.first, bad, "right") - 1
            bounds = np.searchsorted(document, np.arange(chunk.count + 1)).astype(np.int32)
            places = pa.array((bad - lines.first[document]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(chunk.rows.start, chunk.count), pa.array(score),
                 pa.array(np.diff(lines.first), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(bounds), places)],
                names=["doc_id", "score", "n_lines", "bad_lines"],
            )

    kind = "doc_id long, score double, n_lines long, bad_lines array<int>"
    return texts(docs).mapInArrow(mapped(work), kind)


def held_out_query(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Fit on labelled rows whose bucket modulo 4 is not 2, score every row."""
    held = bucket(F.col("doc_id"), 4) == 2
    field = fit(docs, labels.where(~held))
    return scored(docs, field).select(
        "doc_id", held.alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_lines", F.size("bad_lines").cast("long").alias("n_bad_lines"),
    )
