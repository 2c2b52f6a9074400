"""Periodic runs against a brute-force version that tries every start and every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_points
from bazaarscope.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words):
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, n_, q) for (s, n_), q in found.items())


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (len(runs), *best, milli, *digests)


def got(rows):
    return [
        (r.doc_id, (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256,
                    r.collapsed_sha256))
        for r in rows
    ]


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = entry_points.queries()["op12_periodic_runs"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert dict(got(rows)) == {r.doc_id: expected(r.doc_id, r.text) for r in docs}
    assert sum(r.n_runs > 0 for r in rows) > len(docs) // 20


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_every_scale(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):
            block = [b"%d" % rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(1, 90))]
            words += (block * 9)[: rng.randint(1, 6 * len(block))]
        docs.append(words)
    docs += [[], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a", b"b"] * 4, [b"a", b"b"] * 3 + [b"a"], [b"x"] * 5000]
    assert periodic._chunk_runs(docs) == [all_runs(d) for d in docs]


def test_least_lengths():
    """Four periods exactly, and one word less, at every period up to 40."""
    for q in range(1, 41):
        block = [b"w%d" % i for i in range(q)]
        whole = [b"<"] + block * 4 + [b">"]
        want = all_runs(whole)
        assert periodic._chunk_runs([whole]) == [want]
        assert (1, 4 * q, q) in want or q == 1
        assert periodic._chunk_runs([[b"<"] + (block * 4)[:-1] + [b">"]]) == [[]]


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a " * 9), (4, "a " * 9), (None, "b c " * 5), (None, None),
        (5, " x y " * 8), (6, "word " * 60_000), (7, "p\x0bq\x0cr\x1cs"),
    ]
    clash = spark.createDataFrame(
        [(i, t, "x", [1], 5) for i, t in rows], "doc_id long, text string, lang string, runs array<int>, n_words int"
    )
    out = got(periodic.report(clash).collect())
    key = lambda x: (str(x[0]), str(x[1]))
    small = [(i, t) for i, t in rows if i != 6]
    assert sorted((x for x in out if x[0] != 6), key=key) == sorted(((i, expected(i, t)) for i, t in small), key=key)
    (big,) = [x[1] for x in out if x[0] == 6]
    assert big[:5] == (1, 0, 60_000, 1, 60_000_000)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.report(empty).collect() == []
    texts = {r.doc_id: r for r in periodic.periodic_runs(spark.createDataFrame([(9, "a b a b a b a b c")], "doc_id long, text string")).collect()}
    assert texts[9].collapsed == "a b c" and [tuple(r) for r in texts[9].runs] == [(0, 8, 2)]


def test_large_random_text_has_the_planted_runs():
    rng = np.random.default_rng(5)
    words = [b"%d" % x for x in rng.integers(0, 4000, 30_000)]
    want = []
    at = 0
    for q in (8, 9, 15, 16, 31, 100, 1000):
        at += 37
        words[at : at + 4 * q] = [b"%d.%d" % (q, i % q) for i in range(4 * q)]
        want.append((at, 4 * q, q))
        at += 4 * q
    assert periodic._chunk_runs([words]) == [want]
