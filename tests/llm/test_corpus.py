"""The registered corpus queries against plain Python over the smallest test tables."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry_points
from bazaarscope.llm.registry import END_OF_TEXT, VOCABULARY
from check_oracle import compare, duck

from . import brute


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def encoding():
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def run(spark, sf_dir, name):
    return entry_points.queries()[name](spark, sf_dir).collect()


def test_training_order(spark, sf_dir, docs, encoding):
    rows = run(spark, sf_dir, "op1_training_order")
    want = []
    for i, text in docs:
        ids = np.array([*encoding.encode_ordinary(text), END_OF_TEXT], "<u2")
        for s in range(0, len(ids), 512):
            part = ids[s : s + 512]
            want.append((i, s, len(part), hashlib.sha256(part.tobytes()).hexdigest()))
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_sha256) for r in rows) == sorted(want)
    assert sorted(r.slot for r in rows) == list(range(len(want)))
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.slot)]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.3


def test_substring_dedup(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op2_substring_dedup")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}
    assert got == brute.substrings(docs)
    assert any(n for _, n, _ in got.values())


def test_bpe_round_trip(spark, sf_dir, docs, encoding):
    got = {r.doc_id: r for r in run(spark, sf_dir, "op3_bpe_round_trip")}
    for i, text in docs:
        ids = np.array(encoding.encode_ordinary(text), "<u4")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == brute.sha(text)


def test_language_id(spark, sf_dir):
    rows = run(spark, sf_dir, "op4_language_id")
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(langs)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in langs if brute.bucket(i, 4) == 2}
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_decontamination(spark, sf_dir, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = run(spark, sf_dir, "op5_benchmark_decontamination")
    got = {r.doc_id: r["items"] for r in rows}
    assert got == brute.leaks(docs, items)
    assert any(got.values())


def test_quality(spark, sf_dir):
    rows = {r.doc_id: r for r in run(spark, sf_dir, "op6_line_crf_quality")}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    right = [rows[r.doc_id].predicted == r.quality for r in labels]
    assert sum(right) >= 0.85 * len(right)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def test_class_lm(spark, sf_dir, docs):
    rows = {r.doc_id: r for r in run(spark, sf_dir, "op7_class_lm_scores")}
    for i, (held, n, known, train, base) in brute.base_scores(docs).items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())


def test_exact_dedup_matches_sql(spark, sf_dir):
    assert compare(spark, duck(sf_dir), sf_dir, "op8_exact_dedup") is None


def test_near_duplicates(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op9_minhash_near_dedup")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert got == brute.near_duplicates(docs)


def test_line_dedup(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op10_line_dedup")
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in rows} == brute.lines(docs)
