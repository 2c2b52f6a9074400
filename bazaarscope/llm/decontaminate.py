"""Benchmark decontamination by every item-sized window, held against the item exactly.

Documents are scanned map-only. A window at the similarity holds one shingle of the item's prefix
at least, the quarter of its shingles that the fewest items of the block have; so an index of the
prefixes leads from a document's shingles to the items it can hold, and misses none. For such a
pair the weighted Jaccard of the shingle multisets is taken at every start of a window of the
item's size, those clipped at the document's edges included, by running sums. A document of fewer
shingles than an item is covered by its clipped windows.
The benchmark is sent to the tasks in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared
from .words import Chunk, chunks, mapped

WIDTH = 5
PERCENT = 75
BLOCK_ITEMS = 1024  # items sent to the tasks at once
BLOCK_BYTES = 4 << 20  # and bytes of their texts, unless one item has more
_FOLDED = "__folded"


@dataclass
class Item:
    """The multiset of an item's shingles."""

    width: int  # words of a shingle
    ids: np.ndarray  # distinct shingles, ascending
    counts: np.ndarray

    @property
    def size(self) -> int:
        return int(self.counts.sum())


@dataclass
class Prefixes:
    """Items by each shingle of their prefix: those of ``keys[k]`` are ``items[first[k]:first[k + 1]]``."""

    keys: np.ndarray
    first: np.ndarray
    items: np.ndarray

    def met(self, ids: np.ndarray, document: np.ndarray) -> np.ndarray:
        """Distinct pairs of document and item that share a shingle of the item's prefix."""
        place = np.minimum(np.searchsorted(self.keys, ids), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[place] == ids)
        hits = np.unique(np.stack([document[at], place[at]], axis=1), axis=0)
        n = self.first[hits[:, 1] + 1] - self.first[hits[:, 1]]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        items = self.items[np.repeat(self.first[hits[:, 1]], n) + inside]
        return np.unique(np.stack([np.repeat(hits[:, 0], n), items], axis=1), axis=0)


@dataclass
class Block:
    item_ids: list[int]
    items: list[Item]
    prefixes: dict[int, Prefixes]  # by width


def index_items(rows: list[tuple[int, str]]) -> Block:
    """The prefix index of some benchmark items; items without words match nothing."""
    ids, items = [], []
    for item, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")):
        for chunk in chunks(pa.array([text or ""], pa.string())):
            if len(chunk.ids):
                width = min(WIDTH, len(chunk.ids))
                ids.append(item)
                items.append(Item(width, *np.unique(chunk.shingles(width)[1], return_counts=True)))
    prefixes = {}
    for width in sorted({x.width for x in items}):
        own = [k for k, x in enumerate(items) if x.width == width]
        spread = Counter(x for k in own for x in items[k].ids.tolist())
        entries = sorted((x, k) for k in own for x in _prefix(items[k], spread))
        keys, first = np.unique(np.array([x for x, _ in entries], np.uint64), return_index=True)
        prefixes[width] = Prefixes(keys, np.append(first, len(entries)), np.array([k for _, k in entries]))
    return Block(ids, items, prefixes)


def _prefix(item: Item, spread: Counter) -> list[int]:
    """Shingles of which any multiset at the similarity holds one: it may lack a quarter of the
    item's shingles at most, and these are more. Those that few items have come first."""
    spare = item.size * (100 - PERCENT) // 100
    out = []
    for x, n in sorted(zip(item.ids.tolist(), item.counts.tolist()), key=lambda e: (spread[e[0]], e[0])):
        out.append(x)
        spare -= n
        if spare < 0:
            break
    return out


def _best_window(document: np.ndarray, item: Item) -> float:
    """Greatest similarity of all windows of the item's size, clipped at the document's edges;
    0 if it has too few of the item's shingles.

    The j-th occurrence of a shingle that the item has c times counts in the windows that hold it
    and do not hold the (j-c)-th.
    """
    size, n = item.size, len(document)
    place = np.minimum(np.searchsorted(item.ids, document), len(item.ids) - 1)
    at = np.flatnonzero(item.ids[place] == document)
    if 100 * len(at) < PERCENT * size:
        return 0.0
    at = at[np.argsort(place[at], kind="stable")]
    kind = place[at]
    before = np.arange(len(at)) - item.counts[kind]
    same = (before >= 0) & (kind[before] == kind)
    low = np.maximum(at - size, np.where(same, at[before], -size)) + 1
    steps = np.zeros(n + size, np.int64)  # of starts from 1 - size on
    np.add.at(steps, low + size - 1, 1)
    np.add.at(steps, at + size, -1)
    both = np.cumsum(steps)[:-1]
    starts = np.arange(1 - size, n)
    length = np.minimum(starts + size, n) - np.maximum(starts, 0)
    return float((both / (length + size - both)).max())


def matches(chunk: Chunk, block: Block) -> dict[tuple[int, int], float]:
    """Similarity of the best window by (document of the chunk, item of the block)."""
    best: dict[tuple[int, int], float] = {}
    for width, prefixes in block.prefixes.items():
        at, ids = chunk.shingles(width)
        document = chunk.document_of_words()[at]
        for d, item in prefixes.met(ids, document).tolist():
            low, high = np.searchsorted(document, [d, d + 1])
            value = _best_window(ids[low:high], block.items[item])
            if 100 * value >= PERCENT:
                best[d, item] = value
    return best


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark in blocks bounded in items and bytes, whatever its size."""
    rows = benchmark.select(
        benchmark[id_col].cast("long").alias("item"),
        F.lower(benchmark[text_col].cast("string")).alias("text"),
    ).where("item is not null and text is not null")
    held: list[tuple[int, str]] = []
    size = 0
    for item, text in rows.toLocalIterator():
        if held and (len(held) >= BLOCK_ITEMS or size + len(text) > BLOCK_BYTES):
            yield index_items(held)
            held, size = [], 0
        held.append((item, text))
        size += len(text)
    if held:
        yield index_items(held)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """``items`` (ids of the found benchmark items, ascending) and ``similarity`` (of the best
    window, 0 without one) beside the untouched columns of ``docs`` (or those in ``keep``); no
    shuffle. Both sides are lower-cased.

    Null texts match nothing, as do null or wordless items; a text shorter than an item matches it
    as a whole, if it has enough of its shingles;
    items that repeat an id count once. Columns of ``docs`` named like the results are replaced.
    An empty benchmark marks nothing.
    """
    prepared(docs.sparkSession)
    kept = [c for c in keep or docs.columns if c not in ("items", "similarity", _FOLDED)]
    out = docs.select(
        *kept, F.lower(docs[text_col].cast("string")).alias(_FOLDED),
        F.array().cast("array<long>").alias("items"), F.lit(0.0).alias("similarity"),
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for block in blocks_of(benchmark, item_col, item_text_col):
        out = out.mapInArrow(mapped(_marker(block)), fields)
    return out.drop(_FOLDED)


def _marker(block: Block):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        items = [set(x) for x in batch.column("items").to_pylist()]
        best = batch.column("similarity").to_numpy(zero_copy_only=False).copy()
        for chunk in chunks(batch.column(_FOLDED)):
            for (d, item), value in matches(chunk, block).items():
                row = chunk.rows.start + d
                items[row].add(block.item_ids[item])
                best[row] = max(best[row], value)
        found = {"items": pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                 "similarity": pa.array(best)}
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([found.get(c, batch.column(c)) for c in names], names=names)

    return work


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, items, similarity."""
    rows = contaminated(docs, benchmark, keep=["doc_id"])
    return rows.select(
        "doc_id", (F.size("items") > 0).alias("contaminated"),
        F.size("items").cast("long").alias("n_items"), "items", "similarity",
    )
