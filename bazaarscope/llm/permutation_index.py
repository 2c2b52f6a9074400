"""Nearest neighbours by a permutation index: ordered nearest pivots, inverted files, footrule, rerank.

1. Equal vectors are one class, which keeps its ``neighbours + 1`` smallest ids: more of one class
   never reach a result. Everything below works on classes.
2. ``PIVOTS`` vectors with the least hash are pivots: a bounded sample. Every vector is represented by
   its ``PREFIX`` nearest pivots in order and posted in the inverted file of its nearest pivot.
3. Files are put on shelves of about ``SHELF`` vectors; a longer file (many vectors near one pivot)
   is spread over several shelves. A query goes to the shelves that hold one of the files of
   its ``depth`` nearest pivots. ``depth`` is the smallest that holds ``COVERED`` of the true
   neighbours of at most ``PROBES`` query vectors, which are held against all vectors for
   this: how many files have to be read depends on the data, from a few for clustered
   vectors to most of them for directionless ones.
4. On a shelf the posting lists give the footrule distance of prefixes, where an absent pivot
   counts as place ``PREFIX``: it is a constant less twice the sum of ``PREFIX - max(place,
   place')`` over shared pivots. A vector is reranked by exact distance if its footrule is among
   the least ``RERANKED`` of a sample of at most ``SAMPLE`` vectors: one cut for all shelves, so
   a crowd of near copies is reranked as a whole where its queries look for it. Each shelf
   answers a query with its best.
5. The best of all shelves become ids: nearest first, ties to the smaller id.

A shelf's task holds one shelf and streams its queries. The results per query are bounded by the
shelves it visits. Nothing grows with the input in the driver or in a task's closure: pivots,
lengths of ``PIVOTS`` files, the sample's prefixes and the probes' neighbours.

Defined results: vectors that are null, all zero, of no component, or hold a null or non-finite
component take no part, nor do rows without an id and vectors whose length is not the commonest
(of equally common ones the greatest). Repeated rows are candidates of each other; each gives
its own result. With fewer than ``SAMPLE`` classes all of the files read are reranked, and with fewer
than ``10 * (neighbours + 1)`` all files are read, so that no candidate is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, stored
from .words import mapped

PIVOTS, PREFIX = 256, 64
SHELF = 4096
PROBES, COVERED = 64, 0.98
RERANKED, SAMPLE = 0.35, 1024
_BATCH = 256  # queries of one matrix

_CODES = "key string, vector binary, prefix binary, ids array<long>, asks boolean"


def _usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles, no negative zero) of rows that take part."""
    raw = vectors["embedding"].cast("array<double>")
    rows = vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"), F.transform(raw, lambda x: x + F.lit(0.0)).alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).count()
    common = sizes.agg(F.max(F.struct("count", "size"))["size"].alias("size")).first()[0]
    return rows.where(F.size("vector") == F.lit(common or 0))


def _key(vector: Column) -> Column:
    return F.md5(F.array_join(F.transform(vector, lambda x: x.cast("string")), ",").cast("binary"))


def _classes(rows: DataFrame, asked: Column, keep: int) -> DataFrame:
    """One row per different vector: its least ids, and whether any row of it is a query."""
    rows = rows.select("vec_id", "vector", asked.alias("asks"), _key(F.col("vector")).alias("key"))
    # the limit on the rank cuts the copies of a class map-side, before they are shuffled
    spec = Window.partitionBy("key", "asks").orderBy("vec_id")
    rows = rows.withColumn("nth", F.row_number().over(spec)).where(F.col("nth") <= keep)
    return rows.groupBy("key").agg(
        F.any_value("vector").alias("vector"),
        F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep).alias("ids"),
        F.bool_or("asks").alias("asks"),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        return np.array(column.flatten()).reshape(len(column), -1)
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T


def _bytes(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix], pa.binary())


def _coded(pivots: np.ndarray):
    """Each vector's nearest pivots in order, as bytes."""
    width = min(PREFIX, len(pivots))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _matrix(batch.column("vector"))
        order = np.argsort(_squares(x, pivots), axis=1, kind="stable")
        # a query needs the order of all pivots, a posting only its prefix
        asks = np.array(batch.column("asks").to_pylist(), bool)
        places = order.astype("<u2")
        prefix = [row.tobytes() if a else row[:width].tobytes() for row, a in zip(places, asks)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), _bytes(x), pa.array(prefix, pa.binary()), batch.column("ids"), batch.column("asks")],
            ["key", "vector", "prefix", "ids", "asks"],
        )

    return work


def _near(probes: list, neighbours: int):
    """The nearest vectors of each probe within a batch, and their files."""
    keys = np.array([p["key"] for p in probes])
    x = np.stack([np.frombuffer(p["vector"], "<f8") for p in probes])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        y = _matrix(batch.column("vector"))
        own = np.array(batch.column("key").to_pylist())
        d = np.where(keys[:, None] == own, np.inf, _squares(x, y))
        k = min(neighbours, d.shape[1])
        best = np.argpartition(d, k - 1, axis=1)[:, :k]
        files = np.array([np.frombuffer(b[:2], "<u2")[0] for b in batch.column("prefix").to_pylist()], np.int32)
        probe = np.repeat(np.arange(len(x), dtype=np.int32), k)
        at = best.ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(probe), pa.array(d[probe, at]), pa.array(files[at])], ["probe", "d", "file"]
        )

    return work


def _depth(codes: DataFrame, neighbours: int, pivots: int) -> int:
    """How many of its nearest pivots' files a query has to read."""
    probes = codes.where("asks").orderBy(F.xxhash64("key"), "key").limit(PROBES).collect()
    if not probes:
        return pivots
    near = codes.select("key", "vector", "prefix").mapInArrow(
        mapped(_near(probes, neighbours)), "probe int, d double, file int"
    )
    order = Window.partitionBy("probe").orderBy("d", "file")
    near = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= neighbours)
    orders = [np.argsort(np.frombuffer(p["prefix"], "<u2")) for p in probes]  # place of each pivot
    places = [int(orders[r["probe"]][r["file"]]) for r in near.select("probe", "file").collect()]
    return int(np.quantile(places, COVERED, method="higher")) + 1 if places else pivots


def _shelves(lengths: dict[int, int], pivots: int) -> list[tuple[int, int]]:
    """Per file its first shelf and the number of shelves it is spread over."""
    out, shelf, filled = [], 0, 0
    for pivot in range(pivots):
        n = lengths.get(pivot, 0)
        if n > SHELF:
            if filled:
                shelf, filled = shelf + 1, 0
            parts = -(-n // SHELF)
            out.append((shelf, parts))
            shelf += parts
            continue
        if filled and filled + n > SHELF:
            shelf, filled = shelf + 1, 0
        out.append((shelf, 1))
        filled += n
    return out


def _routed(shelves: list[tuple[int, int]], depth: int):
    """Rows of shelves: kind 0 the vectors, kind 1 the queries that visit it."""

    def visits(prefix: bytes) -> list[int]:
        out: set[int] = set()
        for pivot in np.frombuffer(prefix[: 2 * depth], "<u2").tolist():
            first, parts = shelves[pivot]
            out.update(range(first, first + parts))
        return sorted(out)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        prefixes = batch.column("prefix").to_pylist()
        asks, keys = batch.column("asks").to_pylist(), batch.column("key").to_pylist()
        shelf, kind, at = [], [], []
        for i, (prefix, key) in enumerate(zip(prefixes, keys)):
            first, parts = shelves[int(np.frombuffer(prefix[:2], "<u2")[0])]
            own = [first + int(key[:8], 16) % parts]
            seen = visits(prefix) if asks[i] else []
            shelf += own + seen
            kind += [0] * len(own) + [1] * len(seen)
            at += [i] * (1 + len(seen))
        for low in range(0, len(at), 4096):
            part = slice(low, low + 4096)
            rows = batch.select(["key", "vector", "prefix", "ids"]).take(pa.array(at[part]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shelf[part], pa.int32()), pa.array(kind[part], pa.int32()), *rows.columns],
                ["shelf", "kind", "key", "vector", "prefix", "ids"],
            )

    return work


def _lists(prefixes: list[bytes], pivots: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Posting lists laid out by pivot: ``width`` - place of every vector, 0 where it is absent.
    Beside them the nearest pivot of each vector."""
    places = np.stack([np.frombuffer(p[: 2 * width], "<u2") for p in prefixes])
    lists = np.zeros((pivots, len(prefixes)), np.uint8)
    for place in range(width):
        lists[places[:, place], np.arange(len(prefixes))] = width - place
    return lists, places[:, 0].astype(np.int64)


def _shared(lists: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """What shared pivots take off the footrule distance of a query to every vector, by two."""
    own = np.arange(width, 0, -1, dtype=np.uint8)[:, None]
    return np.minimum(lists[order[:width]], own).sum(0, dtype=np.int32)


class _Shelf:
    """The vectors of one shelf with their posting lists."""

    def __init__(self, batches: list[pa.RecordBatch], pivots: int) -> None:
        rows = pa.Table.from_batches(batches).combine_chunks()
        self.keys = np.array(rows.column("key").to_pylist())
        self.ids = rows.column("ids").combine_chunks()
        self.low = np.array([x[0] for x in self.ids.to_pylist()], np.int64)
        self.x = _matrix(rows.column("vector").combine_chunks())
        self.width = min(PREFIX, pivots)
        self.lists, self.files = _lists(rows.column("prefix").to_pylist(), pivots, self.width)

    def answer(self, query: np.ndarray, order: np.ndarray, cut: int, depth: int, keep: int):
        """Positions and exact distances of the best of those whose footrule passes the cut."""
        read = np.zeros(len(self.lists), bool)
        read[order[:depth]] = True
        at = np.flatnonzero(read[self.files] & (_shared(self.lists, order, self.width) >= cut))
        d = np.sqrt(((self.x[at] - query) ** 2).sum(1))
        best = np.lexsort((self.low[at], d))[:keep]
        return at[best], d[best]


_HITS = "query string, key string, d double, low long, ids array<long>"


def _searched(pivots: int, depth: int, keep: int, sample: list[bytes]):
    width = min(PREFIX, pivots)
    lists, _ = _lists(sample, pivots, width)
    rank = max(int(len(sample) * (1 - RERANKED)), 0) if len(sample) >= SAMPLE else 0
    schema = pa.schema([("query", pa.string()), ("key", pa.string()), ("d", pa.float64()), ("low", pa.int64()),
                        ("ids", pa.list_(pa.int64()))])

    def answers(shelf: _Shelf, batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, at, ds = [], [], []
        x = _matrix(batch.column("vector"))
        for key, q, prefix in zip(batch.column("key").to_pylist(), x, batch.column("prefix").to_pylist()):
            order = np.frombuffer(prefix, "<u2")
            cut = np.partition(_shared(lists, order, width), rank)[rank] if rank else 0
            found, d = shelf.answer(q, order, cut, depth, keep)
            keys += [key] * len(found)
            at.append(found)
            ds.append(d)
        at = np.concatenate(at)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(shelf.keys[at].tolist(), pa.string()), pa.array(np.concatenate(ds)),
             pa.array(shelf.low[at]), shelf.ids.take(pa.array(at))],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, shelf = None, [], None
        for batch in batches:
            tags = np.stack([np.array(batch.column("shelf")), np.array(batch.column("kind"))])
            edges = np.flatnonzero((tags[:, 1:] != tags[:, :-1]).any(0)) + 1
            for low, high in zip([0, *edges], [*edges, batch.num_rows]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if number != tags[0, low]:
                    number, rows, shelf = tags[0, low], [], None
                if tags[1, low] == 0:
                    rows.append(part)
                elif rows:
                    shelf = shelf or _Shelf(rows, pivots)
                    for first in range(0, part.num_rows, _BATCH):
                        yield answers(shelf, part.slice(first, _BATCH))

    return run


def nearest_classes(rows: DataFrame, asked: Column, neighbours: int) -> DataFrame:
    """``query, key, d, low, ids``: the best classes of every class that holds a query."""
    keep = neighbours + 1
    classes = stored(_classes(rows, asked, keep), "classes")
    sample = classes.orderBy(F.xxhash64("key"), "key").limit(PIVOTS).select("vector").collect()
    if not sample:
        return rows.sparkSession.createDataFrame([], _HITS)
    pivots = np.array([r["vector"] for r in sample])
    codes = stored(classes.mapInArrow(mapped(_coded(pivots)), _CODES), "codes")
    file = F.conv(F.hex(F.reverse(F.substring("prefix", 1, 2))), 16, 10).cast("int")
    lengths = {r[0]: r[1] for r in codes.groupBy(file.alias("file")).count().collect()}
    some = codes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select(F.substring("prefix", 1, 2 * PREFIX).alias("p"))
    some = [bytes(r["p"]) for r in some.collect()]
    few = sum(lengths.values()) < 10 * keep
    depth = len(pivots) if few else _depth(codes, neighbours, len(pivots))
    shelves = _shelves(lengths, len(pivots))
    routed = codes.mapInArrow(
        mapped(_routed(shelves, depth)),
        "shelf int, kind int, key string, vector binary, prefix binary, ids array<long>",
    )
    routed = routed.repartition("shelf").sortWithinPartitions("shelf", "kind")
    hits = routed.mapInArrow(_searched(len(pivots), depth, keep, some), _HITS)
    # by distance, then least id: the first classes hold the first ids
    best = Window.partitionBy("query").orderBy("d", "low", "key")
    hits = hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= keep)
    return hits.drop("nth")


def search(vectors: DataFrame, asked: Column, neighbours: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` of every row of ``vectors`` (``vec_id``, ``embedding``) for
    which ``asked`` (a condition on ``vec_id``) holds: its nearest other rows by Euclidean
    distance."""
    prepared(vectors.sparkSession)
    rows = _usable(vectors)
    hits = nearest_classes(rows, asked, neighbours)
    # ids of each query class in order: at most one more than asked for, in case one is the query's own
    flat = hits.select("query", "d", (F.col("query") == F.col("key")).alias("same"), F.explode("ids").alias("id"))
    order = Window.partitionBy("query").orderBy("d", "id")
    flat = flat.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= neighbours + 1)
    lists = flat.groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("nth", "id", "d", "same"))).alias("near")
    )
    queries = rows.where(asked).select("vec_id", _key(F.col("vector")).alias("query"))
    found = queries.join(lists, "query")
    own = F.get(F.filter("near", lambda n: n["same"] & (n["id"] == F.col("vec_id"))), 0)["nth"]
    found = found.select("vec_id", "near", own.alias("own"))
    others = F.filter("near", lambda n: F.coalesce(n["nth"] != F.col("own"), F.lit(True)))
    found = found.select(
        F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, neighbours)).alias("place", "n")
    )
    return found.select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.d").alias("score")
    )


def report(vectors: DataFrame) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    return search(vectors, F.col("vec_id") % 100 == 0, 10)
