"""Pairs that sketches rule out are no links, and copies of one text need no pairs among themselves."""

import itertools
import random

import numpy as np
import pyarrow as pa

from bazaarscope.llm import line_dedup, linking, minhash
from bazaarscope.llm.words import chunks


def _texts(n, words, edits, seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for i in range(1, n):
        own = list(base)
        for k in rnd.sample(range(words), edits(i)):
            own[k] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    texts = _texts(12, 90, lambda i: 2 * i, 3)
    (chunk,) = chunks(pa.array(texts), fold=True)
    ids, bounds = minhash.shingle_sets(chunk)
    sets = [set(ids[a:b].tolist()) for a, b in itertools.pairwise(bounds)]
    bits = np.unpackbits(minhash.sketches(ids, bounds).view(np.uint8), axis=1)
    for x, y in itertools.combinations(range(12), 2):
        differing = int((bits[x] != bits[y]).sum())
        assert 0 < differing <= len(sets[x] ^ sets[y])


def test_edited_copies_meet_their_original_and_not_each_other(spark, monkeypatch):
    """The original has neither the lowest nor the highest id, and most copies are unlike each other."""
    texts = _texts(61, 120, lambda i: 3 if i <= 30 else 9, 5)
    ids = [30, *range(30), *range(31, 61)]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    seen = []
    counted = minhash.shared

    def counting(pairs, rows):
        pairs = pairs.localCheckpoint()
        seen.append(pairs.count())
        return counted(pairs, rows)

    monkeypatch.setattr(minhash, "shared", counting)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in zip(ids, texts)}
    root = {i: i for i in ids}
    for a, b in itertools.combinations(sorted(ids), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    assert found == root
    assert sum(seen) < 61 * 60 // 2 // 4, seen


def test_line_sketches_bound_the_difference(spark):
    lines = _texts(40, 30, lambda i: 1 + i // 8, 9)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    for crowd in (64, 1):
        linking.CROWD, before = crowd, linking.CROWD
        try:
            rows = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).collect()}
        finally:
            linking.CROWD = before

        def grams(t):
            return {t[i : i + 5] for i in range(len(t) - 4)}

        sets = [grams(t) for t in lines]
        root = list(range(40))
        for a, b in itertools.combinations(range(40), 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
        assert rows == {i: int(root[i] != i) for i in range(40)}
