"""Candidate windows of op2 travel in rows that the shuffle can compress."""

import numpy as np
import pyarrow as pa
import pytest

from bazaarscope.llm import substring_dedup


def test_window_row_compresses_to_its_hash_and_place():
    texts = [" ".join(f"w{d}x{i}" for i in range(400)) for d in range(40)]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(7_000_000, 7_000_040), pa.int64()),
        "text": pa.array(texts),
        "hits": pa.array([list(range(0, 390, 5))] * 40, pa.list_(pa.int32())),
    })
    (out,) = substring_dedup._windows(iter([batch]))
    # as the shuffle writes them: eight bytes a field behind the null bits, in order of the partitions
    rows = np.column_stack([np.zeros(out.num_rows, np.int64), *(
        np.asarray(out.column(i).cast(pa.int64())) for i in range(out.num_columns)
    )])
    parts = [rows[rows[:, 1] % 8 == i] for i in range(8)]
    if not pa.Codec.is_available("lz4_raw"):
        pytest.skip("no lz4")
    size = sum(len(pa.compress(np.ascontiguousarray(p).tobytes(), "lz4_raw", asbytes=True)) for p in parts)
    assert out.num_rows == 40 * 351
    assert size < 17 * out.num_rows, size / out.num_rows
