"""The permutation index against distances of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from bazaarscope.llm import permutation_index as index


def usable(rows):
    out = []
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        out.append((i, np.array(v, float)))
    sizes = [len(v) for _, v in out]
    common = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    return [(i, v) for i, v in out if len(v) == common]


def brute(rows, divisor=100, k=10):
    """Per query row the exact list of (distance, id)."""
    rows = usable(rows)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = []
    for at in np.flatnonzero(ids % divisor == 0):
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != at][:k]
        out.append((int(ids[at]), [(float(d[j]), int(ids[j])) for j in order]))
    return out


def grouped(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    return {q: [own[i] for i in sorted(own)] for q, own in out.items()}


def recall(got, want):
    found = sum(len({i for _, i in got.get(q, [])} & {i for _, i in near}) for q, near in want)
    return found / sum(len(near) for _, near in want)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.1"])
def test_recall_and_scores(spark, table):
    path = f"/root/testdata/{table}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    frame = entry_points.queries()["op11_permutation_index"](spark, path)
    assert frame.columns == ["query_id", "rank", "vec_id", "score"]
    got, want = grouped(frame), brute(rows)
    assert set(got) == {q for q, _ in want}
    x = {i: np.array(v, float) for i, v in rows}
    for q, near in got.items():
        assert len(near) == 10 and near == sorted(near) and q not in {i for _, i in near}
        np.testing.assert_allclose([d for d, _ in near], [np.linalg.norm(x[q] - x[i]) for _, i in near], rtol=1e-12)
    assert recall(got, want) >= 0.95


SCHEMA = "vec_id long, embedding array<double>, label string, query string, key int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "q", 3) for i, v in rows], SCHEMA)


def test_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(1, 40)]
    rows += [(100, rows[3][1]), (200, None), (300, []), (400, [0.0, 0.0, -0.0]), (500, [1.0, None, 2.0]),
             (600, [1.0, float("nan"), 2.0]), (700, [float("inf"), 0.0, 0.0]), (None, [1.0, 2.0, 3.0]),
             (800, [1.0, 2.0]), (0, [1.0, 0.0, 2.0]), (50, [1.0, -0.0, 2.0]), (51, [1.0, 0.0, 2.0])]
    got = grouped(index.report(frame(spark, rows)))
    want = dict(brute(rows))
    assert set(got) == set(want) == {0, 100}
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        np.testing.assert_allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-12)
    assert got[0][:2] == [(0.0, 50), (0.0, 51)]
    few = [(0, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [1.0, 2.0])]
    assert grouped(index.report(frame(spark, few))) == {0: [(0.0, 2), (1.0, 1)]}
    assert grouped(index.report(frame(spark, [(0, [1.0])]))) == {}
    assert index.report(frame(spark, [])).collect() == []


def test_copies_and_repeated_ids(spark):
    """A third of all rows hold one vector; its copies, queries among them, give ties by id."""
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(3000)]
    rows = [(5000 - i, v) for i, v in rows]
    got, want = grouped(index.report(frame(spark, rows))), brute(rows)
    assert recall(got, want) >= 0.95
    assert any(near[9][0] == 0.0 for _, near in want)
    for q, near in want:
        if near[9][0] == 0.0:
            assert got[q] == near
    twice = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 2.0])]
    out = sorted(tuple(r) for r in index.report(frame(spark, twice)).collect())
    assert out == [(0, 1, 0, 0.0), (0, 1, 0, 0.0), (0, 2, 1, 2.0), (0, 2, 1, 2.0)]


def test_clustered_vectors_read_few_files(spark, monkeypatch):
    """A long file spreads over several shelves, and queries of far clusters do not visit it."""
    monkeypatch.setattr(index, "SHELF", 64)
    monkeypatch.setattr(index, "PIVOTS", 32)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 6)) * 50
    rows = [(i, (centres[0 if i % 3 == 0 else i % 20] + rng.normal(size=6)).tolist()) for i in range(2000)]
    read = []
    real = index._routed
    monkeypatch.setattr(index, "_routed", lambda shelves, depth: read.append((shelves, depth)) or real(shelves, depth))
    got, want = grouped(index.search(frame(spark, rows), F.col("vec_id") % 50 == 0)), brute(rows, 50)
    assert recall(got, want) >= 0.95
    (shelves, depth), = read
    assert depth <= 16 and max(n for _, n in shelves) > 1
