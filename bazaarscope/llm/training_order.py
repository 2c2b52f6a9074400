"""Training-order materialisation: token sequences in keyed random order, in fixed-stride shards.

Every document is encoded, closed with an end token and cut into sequences. A keyed Feistel
network over the sequence numbers, cycle-walking until it lands inside their domain, gives each
sequence a position; equal ranges of positions are the shards. As positions are spread evenly, the
ranges need no sampling and stay balanced whatever the sources. A task sorts its range and writes
records of one fixed size, so record ``i`` begins at byte ``i * stride``. A sequence's global slot
is the number of records in earlier shards plus its place in its own.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import prepared, scratch, stored, texts
from .words import mapped, mixed

LENGTH = 512  # tokens of a sequence
SHARD_BYTES = 256 << 20  # text bytes behind a shard; small inputs get a shard per shuffle partition
HEADER = np.dtype([("doc_id", "<i8"), ("start", "<u4"), ("n", "<u4")])
_ROUNDS = 6


def record_type(length: int) -> np.dtype:
    return np.dtype([*((n, HEADER[n]) for n in HEADER.names), ("ids", "<u2", (length,))])


def feistel(values: np.ndarray, domain: int, key: int) -> np.ndarray:
    """A keyed permutation of ``0 .. domain - 1``: balanced Feistel rounds over the next even
    power of two, repeated for the values that land outside until they are inside."""
    half = max(1, math.ceil(math.log2(max(2, domain)) / 2))
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = mixed(np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))
    out = values.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= domain]
    return out


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    own = Encoder(path, pattern, encode=_merged)
    own.v.core = tiktoken.Encoding(
        "own", pat_str=pattern, mergeable_ranks=own.v.ranks, special_tokens={}
    )._core_bpe
    return own


def _merged(vocabulary, piece: bytes) -> list[int]:
    return vocabulary.core.encode_single_piece(piece)


def sequences(docs: DataFrame, path: str, pattern: str, end: int, length: int, key: int) -> DataFrame:
    """``position, doc_id, start, ids``: the sequences of all documents with their positions.

    The domain is the span of document ids times the sequences the longest text can have. Ids
    whose span would overflow it are folded; equal positions are harmless, as slots are ranks.
    """
    low, high, longest = docs.agg(
        F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text"))
    ).first()
    low, high = (0, 0) if low is None else (low, high)
    most = (longest or 0) // length + 1  # a token has at least one byte; one more for the end
    documents = min(high - low + 1, (1 << 62) // most)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = batch.column("doc_id").fill_null(low).to_numpy()
        names, numbers, starts, parts = [], [], [], []
        for row, ids in enumerate(_encoder(path, pattern).column(batch.column("text"))):
            ids = np.append(ids, end).astype("<u2")
            base = (int(known[row]) - low) % documents * most
            for k, at in enumerate(range(0, len(ids), length)):
                names.append(known[row])
                numbers.append(base + k)
                starts.append(at)
                parts.append(ids[at : at + length].tobytes())
        position = feistel(np.array(numbers, np.uint64), documents * most, key)
        yield pa.RecordBatch.from_arrays(
            [pa.array(position.astype(np.int64)), pa.array(names, pa.int64()),
             pa.array(starts, pa.int64()), pa.array(parts, pa.binary())],
            names=["position", "doc_id", "start", "ids"],
        )

    kind = "position long, doc_id long, start long, ids binary"
    out = docs.mapInArrow(mapped(work), kind)
    return out.withColumn("share", F.col("position") / F.lit(float(documents * most)))


def _writer(folder: str, length: int):
    kind = record_type(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        shard, out, n, name = None, None, 0, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                shard = batch.column("shard")[0].as_py()
                name = f"{root}/shard-{shard:07d}"
                partial = f"{name}.{uuid.uuid4().hex}"
                out = files.open_output_stream(partial)
            records = np.zeros(batch.num_rows, kind)
            records["doc_id"] = batch.column("doc_id").to_numpy()
            records["start"] = batch.column("start").to_numpy()
            for row, ids in enumerate(batch.column("ids").to_pylist()):
                own = np.frombuffer(ids, "<u2")
                records["n"][row] = len(own)
                records["ids"][row, : len(own)] = own
            out.write(records.tobytes())
            n += batch.num_rows
        if out is not None:
            out.close()
            # a repeated task writes the same bytes; the last whole file has the name
            files.move(partial, f"{name}.bin")
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "records": pa.array([n], pa.int64())}
            )

    return run


def materialise(
    docs: DataFrame, folder: str, path: str, pattern: str, end: int, length: int = LENGTH,
    key: int = 20240229, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write the shards into ``folder``, a URI all executors reach, and return the manifest:
    shard, records, first_slot.

    Null texts count as empty and give one sequence, the end token. Repeated rows are written each;
    null ids are written as the least id. An empty table writes nothing. Token ids must be below
    65,536. Texts are encoded once; only token ids are shuffled, once.
    """
    spark = prepared(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    placed = sequences(rows, path, pattern, end, length, key)
    shard = F.least(F.lit(shards - 1), F.floor(F.col("share") * shards)).cast("int")
    written = (
        placed.select("position", "doc_id", "start", "ids", shard.alias("shard"))
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("position", "doc_id", "start")
        .mapInArrow(_writer(folder, length), "shard int, records long")
    )
    written = stored(written, "manifest")  # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("first_slot", F.coalesce(F.sum("records").over(before), F.lit(0)))


def read_slots(
    spark: SparkSession, manifest: DataFrame, folder: str, length: int = LENGTH, from_slot: int = 0
) -> DataFrame:
    """slot, shard, record, doc_id, start, n_tokens, ids: the records from a slot onwards.

    Each task reads a shard sequentially from a computed offset, so reading resumes anywhere.
    """
    kind = record_type(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                skip = max(0, from_slot - row["first_slot"])
                if skip >= row["records"]:
                    continue
                with files.open_input_file(f"{root}/shard-{row['shard']:07d}.bin") as source:
                    source.seek(skip * kind.itemsize)
                    while raw := source.read(kind.itemsize * 1024):
                        own = np.frombuffer(raw, kind)
                        places = np.arange(skip, skip + len(own))
                        skip += len(own)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(row["first_slot"] + places),
                             pa.array(np.full(len(own), row["shard"], np.int32)), pa.array(places),
                             pa.array(own["doc_id"]), pa.array(own["start"].astype(np.int64)),
                             pa.array(own["n"].astype(np.int64)),
                             pa.array([r["ids"][: r["n"]].tobytes() for r in own], pa.binary())],
                            names=["slot", "shard", "record", "doc_id", "start", "n_tokens", "ids"],
                        )

    out = "slot long, shard int, record long, doc_id long, start long, n_tokens long, ids binary"
    parts = manifest.repartitionById(max(1, manifest.count()), F.col("shard"))
    return parts.mapInArrow(run, out)


def report(docs: DataFrame, path: str, pattern: str, end: int) -> DataFrame:
    """Materialise into the shared scratch folder and describe every record read back."""
    spark = docs.sparkSession
    folder = scratch(prepared(spark), "training-order")
    folder = folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:"))
    manifest = materialise(docs, folder, path, pattern, end)
    return read_slots(spark, stored(manifest, "slots"), folder).select(
        "slot", "shard", "record", "doc_id", "start", "n_tokens", F.sha2("ids", 256).alias("ids_sha256")
    )
