"""Language-model scores from Brown class-based bigrams.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)). Exchange clustering moves words between
classes while the training bigrams become likelier. Its items are the most frequent words and, for
all other words, their last three bytes hashed into a fixed number of endings; so every word,
known or not, has a class and the fit stays bounded, while all counts come from the whole corpus.
Word counts stay a distributed table: only the most frequent ones are sent to tasks, every other
word of a text is looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, prepared, stored, texts
from .words import Chunk, chunks, mapped, signed

FREQUENT = 1024  # words that are items of the clustering
ENDINGS = 511  # hashed endings that stand for all other words
CLASSES = 64
SWEEPS = 6
HOT = 1 << 18  # words whose counts are sent to every task, 4 MB
SPREAD = 0.1  # added to each count, and once for an unseen word
TRUST = 10.0  # weight of the class frequencies in a class's transitions
END_ID = np.int64(-7_046_029_254_386_353_131)  # the id of the end token
_FLUSH = 1 << 21
_ITEMS = FREQUENT + ENDINGS + 1
_END = _ITEMS - 1


def endings(chunk: Chunk) -> np.ndarray:
    """Hash of the last three bytes of each word, A-Z folded."""
    out = np.zeros(len(chunk.ids), np.int64)
    for back in (1, 2, 3):
        at = chunk.ends - back
        byte = chunk.data[np.maximum(at, 0)].astype(np.int64)
        byte += 32 * ((byte >= 65) & (byte <= 90))
        out = out * 263 + np.where(at >= chunk.starts, byte, 0)
    return out * 2_654_435_761 % 4_294_967_291 % ENDINGS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task, combined over about two million words at a time."""
    ids: list[np.ndarray] = []
    tails: list[np.ndarray] = []
    held = ends = 0

    def flush() -> pa.RecordBatch:
        word, at, n = np.unique(np.concatenate(ids), return_index=True, return_counts=True)
        return _counts_batch(signed(word), np.concatenate(tails)[at], n)

    for batch in batches:
        ends += batch.num_rows
        for chunk in chunks(batch.column("text"), fold=True):
            ids.append(chunk.ids)
            tails.append(endings(chunk).astype(np.int32))
            held += len(chunk.ids)
            if held >= _FLUSH:
                yield flush()
                ids, tails, held = [], [], 0
    if held:
        yield flush()
    if ends:
        yield _counts_batch(np.array([END_ID]), np.array([-1], np.int32), np.array([ends]))


def _counts_batch(word, tail, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(word, pa.int64()), pa.array(tail, pa.int32()), pa.array(n, pa.int64())],
        names=["word", "ending", "c"],
    )


@dataclass
class Lookup:
    """Sorted ids of the hot words, their counts and clustering items (-1: by the ending)."""

    ids: np.ndarray
    counts: np.ndarray
    items: np.ndarray

    def find(self, words: np.ndarray) -> np.ndarray:
        """Row of each word, -1 if it is not hot."""
        if not len(self.ids):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.ids, words), len(self.ids) - 1)
        return np.where(self.ids[at] == words, at, -1)

    def items_of(self, chunk: Chunk, rows: np.ndarray) -> np.ndarray:
        own = np.where(rows >= 0, self.items[rows], -1) if len(self.ids) else rows
        return np.where(own >= 0, own, FREQUENT + endings(chunk))


def _with_ends(chunk: Chunk, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Token values with each document's end token; bounds of the documents."""
    out = np.insert(values, chunk.first[1:], end)
    return out, chunk.first + np.arange(chunk.count + 1)


def _transitions(lookup: Lookup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_ITEMS * _ITEMS, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column("text"), fold=True):
                items = lookup.items_of(chunk, lookup.find(signed(chunk.ids)))
                tokens, _ = _with_ends(chunk, items, _END)
                # a text begins after an end, so the stream is already the bigrams
                before = np.insert(tokens[:-1], 0, _END) if len(tokens) else tokens
                pairs, n = np.unique(before * _ITEMS + tokens, return_counts=True)
                total[pairs] += n
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int64()), pa.array(total[full])], names=["pair", "c"]
        )

    return run


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each item after exchange clustering of a square matrix of bigram counts."""
    n = len(pairs)
    weight = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    label = np.zeros(n, np.int64)
    label[order] = np.arange(n) % classes
    one = np.zeros((n, classes))
    one[np.arange(n), label] = 1
    table = one.T @ pairs @ one
    for _ in range(sweeps):
        moved = 0
        for w in order[weight[order] > 0]:
            after = np.bincount(label, pairs[w], classes)
            before = np.bincount(label, pairs[:, w], classes)
            self_n, old = pairs[w, w], label[w]
            after[old] -= self_n
            before[old] -= self_n
            table[old] -= after
            table[:, old] -= before
            table[old, old] -= self_n
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            known = _plogp(table)
            gain = (_plogp(table + after) - known).sum(axis=1)
            gain += (_plogp(table + before[:, None]) - known).sum(axis=0)
            own = np.diagonal(table)
            gain += _plogp(own + after + before + self_n) + _plogp(own)
            gain -= _plogp(own + after) + _plogp(own + before)
            gain -= _plogp(rows + after.sum() + self_n) - _plogp(rows)
            gain -= _plogp(columns + before.sum() + self_n) - _plogp(columns)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new] += after
            table[:, new] += before
            table[new, new] += self_n
            moved += new != old
            label[w] = new
        if not moved:
            break
    return label


@dataclass
class Model:
    counts: DataFrame  # word, c of every training word
    lookup: Lookup
    tokens: int
    types: int
    label: np.ndarray
    log_step: np.ndarray  # log10 P(class | class before)
    log_class: np.ndarray  # log10 of the class's emission denominator


def fit(docs: DataFrame) -> Model:
    """Counts over all given ``(doc_id, text)`` rows, then the classes and their transitions."""
    kind = "word long, ending int, c long"
    parts = docs.select("text").mapInArrow(_counted, kind)
    counts = parts.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))
    counts = stored(counts, "words")
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = counts.where(F.col("word") != int(END_ID)).orderBy(F.desc("c"), "word").limit(HOT).toArrow()
    order = np.lexsort((hot["word"].to_numpy(), -hot["c"].to_numpy()))
    ids, c = hot["word"].to_numpy()[order], hot["c"].to_numpy()[order]
    items = np.where(np.arange(len(ids)) < FREQUENT, np.arange(len(ids)), -1)
    by_id = np.argsort(ids)
    lookup = Lookup(ids[by_id], c[by_id], items[by_id])

    cells = docs.select("text").mapInArrow(_transitions(lookup), "pair long, c long")
    cells = cells.groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    pairs = np.zeros(_ITEMS * _ITEMS)
    pairs[cells["pair"].to_numpy()] = cells["c"].to_numpy()
    pairs = pairs.reshape(_ITEMS, _ITEMS)
    label = exchange(pairs)

    top = [int(x) for x in ids[:FREQUENT]]
    rare = counts.where((F.col("ending") >= 0) & ~F.col("word").isin(top)) if top else counts.where("ending >= 0")
    by_ending = {r[0]: r[1] for r in rare.groupBy("ending").count().collect()}
    kinds = np.zeros(_ITEMS)
    kinds[: len(top)] = 1
    kinds[_END] = 1
    for ending, n in by_ending.items():
        kinds[FREQUENT + ending] = n
    class_types = np.bincount(label, kinds, CLASSES)
    class_tokens = np.bincount(label, pairs.sum(axis=0), CLASSES)
    one = np.zeros((_ITEMS, CLASSES))
    one[np.arange(_ITEMS), label] = 1
    table = one.T @ pairs @ one
    share = (class_tokens + 1) / (class_tokens.sum() + CLASSES)
    step = (table + TRUST * share) / (table.sum(axis=1, keepdims=True) + TRUST)
    return Model(
        counts.select("word", "c"), lookup, tokens, types, label,
        np.log10(step), np.log10(class_tokens + SPREAD * (class_types + 1)),
    )


def _summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every ``(doc_id, text)`` row by id."""
    lookup, label, log_step, log_class = model.lookup, model.label, model.log_step, model.log_class
    base = float(np.log10(model.tokens + SPREAD * (model.types + 1)))
    end_log = float(np.log10((model.counts.where(F.col("word") == int(END_ID)).select("c").first() or [0])[0] + SPREAD))

    def hot(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batch.column("text"), fold=True):
            rows = lookup.find(signed(chunk.ids))
            known = rows >= 0
            logs = np.where(known, np.log10(lookup.counts[rows] + SPREAD), 0.0) if len(lookup.ids) else np.zeros(len(rows))
            tokens, bounds = _with_ends(chunk, label[lookup.items_of(chunk, rows)], label[_END])
            before = np.insert(tokens[:-1], 0, label[_END]) if len(tokens) else tokens
            n = np.diff(bounds)
            shared = _summed(logs, chunk.first) + end_log
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(chunk.rows.start, chunk.count),
                 pa.array(n, pa.int64()), pa.array(_summed(known, chunk.first).astype(np.int64) + 1),
                 pa.array(shared - n * base),
                 pa.array(shared + _summed(log_step[before, tokens] - log_class[tokens], bounds))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    def rare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batch.column("text"), fold=True):
            words = signed(chunk.ids)
            cold = np.flatnonzero(lookup.find(words) < 0)
            document = chunk.document_of_words()[cold]
            order = np.lexsort((words[cold], document))
            word, document = words[cold][order], document[order]
            fresh = np.ones(len(word), bool)
            fresh[1:] = (word[1:] != word[:-1]) | (document[1:] != document[:-1])
            at = np.flatnonzero(fresh)
            ids = batch.column("doc_id").slice(chunk.rows.start, chunk.count)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(document[at])), pa.array(word[at]),
                 pa.array(np.diff(np.append(at, len(word))), pa.int64())],
                names=["doc_id", "word", "n"],
            )

    whole = docs.mapInArrow(mapped(hot), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    cold = docs.mapInArrow(mapped(rare), "doc_id long, word long, n long")
    cold = cold.join(model.counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = F.col("n") * F.log10(F.col("c") + F.lit(SPREAD))
    cold = cold.select(
        "doc_id", F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0)).alias("n_known"),
        log.alias("base_score"), log.alias("score"),
    )
    return whole.unionByName(cold).groupBy("doc_id").agg(
        *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))
    )


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose bucket modulo 10 is not 0 and scores every row. Null texts count as
    empty: their only token is the end. Rows that repeat an id are summed into one row, as are
    rows with a null id.
    """
    prepared(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    held = bucket(F.col("doc_id"), 10) == 0
    model = fit(rows.where(~held))
    return score(rows, model).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
