"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bazaarscope.llm import bpe, class_lm, decontaminate, exact_dedup, language_id, line_dedup
from bazaarscope.llm import minhash, quality, substring_dedup, training_order
from bazaarscope.llm.common import scratch
from bazaarscope.llm.registry import END_OF_TEXT, VOCABULARY

from . import brute

BPE = (VOCABULARY, public_tokenizers.PATTERN)
rng = np.random.default_rng(5)
NAMES = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(4000)]
LONG = " ".join(rng.choice(NAMES, 30_000))
PASSAGE = " ".join(rng.choice(NAMES, 70))
BODY = " ".join(rng.choice(NAMES, 90))
ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One  two"), (6, LONG),
    (7, f"{LONG} tail"), (8, "same words here again and again"), (9, "same words here again and again"),
    (10, PASSAGE), (11, f"begin {PASSAGE} end"), (12, BODY), (13, BODY.replace(" ", "\n", 1)),
    (14, f"{BODY} more"), (15, "word " * 3000), (16, "!!! ???"), (17, "été à l'école 　fin\x1c"),
    (18, "x" * 50_000), (18, "x" * 50_000), (None, "no id at all"), (-3, "same words here again and again"),
    (19, "\n\n\nlast"), (20, "a line that is nearly the same as another one in here, yes it is\nb"),
    (21, "a line that is nearly the same as another one in here, yes it was\nc"),
]
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, " \
    "items string, h string, node string, key string, gone string, kept string, n string, first string"


def frame(spark, rows=ROWS):
    full = [(i, t, "en", "s", 1, 0.5, *["x"] * 8) for i, t in rows]
    return spark.createDataFrame(full, CLASHING).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def test_training_order_edges(spark, docs, empty):
    folder = scratch(spark, "order")
    folder = folder if "://" in folder else f"file://{folder}"
    manifest = training_order.materialise(docs, folder, *BPE, END_OF_TEXT, length=64).persist()
    rows = training_order.read_slots(spark, manifest, folder, length=64)
    slots = rows.collect()
    assert sorted(r.slot for r in slots) == list(range(len(slots)))
    assert sum(r.doc_id == 18 for r in slots) % 2 == 0  # a repeated row is written twice
    assert sum(r.start == 0 for r in slots) == len(ROWS)
    later = training_order.read_slots(spark, manifest, folder, length=64, from_slot=100).collect()
    assert {tuple(r) for r in later} == {tuple(r) for r in slots if r.slot >= 100}
    assert training_order.materialise(empty, folder + "-none", *BPE, END_OF_TEXT).count() == 0


@pytest.mark.parametrize("domain", [1, 2, 3, 64, 1000])
def test_feistel_is_a_permutation(domain):
    assert sorted(training_order.feistel(np.arange(domain), domain, 3).tolist()) == list(range(domain))


def test_substring_edges(docs, empty):
    got = {}
    for r in substring_dedup.dedup_substrings(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    want = brute.substrings(dict(ROWS).items())
    assert {i: set(v) for i, v in got.items() if i is not None} == {i: {v} for i, v in want.items()}
    assert len(got[18]) == 2 and len(got[None]) == 1
    assert got[7][0][1] == 30_000 and got[11][0][1] == 70
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_bpe_edges(docs, empty):
    rows = bpe.encode_decode(docs, *BPE).collect()
    assert len(rows) == len(ROWS)
    want = sorted((i or 0, brute.sha(t or "")) for i, t in ROWS)
    assert sorted((r.doc_id or 0, r.decoded_sha256) for r in rows) == want
    assert bpe.encode_decode(empty, *BPE).count() == 0


def test_bpe_appends_and_edits():
    v = bpe.vocabulary(*BPE)
    piece = b"antidisestablishmentarianism"
    grown = bpe.PrefixEncoder(v)
    for i in range(len(piece)):
        grown.append(piece[i : i + 1])
    assert grown.tokens() == bpe.PrefixEncoder(v, piece).tokens()
    edited = bpe.PrefixEncoder(v, piece).edit(4, 3, b"XY")
    assert edited.tokens() == bpe.PrefixEncoder(v, piece[:4] + b"XY" + piece[7:]).tokens()


def test_language_edges(spark, docs, empty):
    model = language_id.fit(frame(spark, [(1, "the and of"), (2, "und der die"), (3, None), (None, "x")]))
    rows = language_id.predict(docs, model)
    assert rows.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "score"]
    got = {r.doc_id: r for r in rows.collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 16))
    assert got[17].lang_pred == "en"
    none = language_id.fit(empty)
    assert language_id.predict(docs, none).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(empty, model).count() == 0


@pytest.mark.parametrize("n", [1, 400, 401, 500_000_000, 10**12, 10**18])
def test_language_sample_is_bounded_and_never_empty_at_any_size(n):
    share = language_id.draws_taken(n, 400) / (1 << 62)
    assert share * n == pytest.approx(min(n, 400), rel=0.01)


def test_language_sample_follows_the_rate(spark, monkeypatch):
    rows = frame(spark, [(i, "the and of it" if i % 2 else "und der die das") for i in range(2000)])
    labelled = rows.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    seen = []
    monkeypatch.setattr(language_id, "fit_claim", lambda labels, _: seen.extend(labels))
    language_id.fit(labelled, per_language=100)
    # binomial with mean 100: six standard deviations
    assert all(40 < seen.count(x) < 160 for x in ("en", "de"))


def test_contradicting_labels_count_as_bad(spark, docs):
    whole = spark.createDataFrame([(i, q) for i in (1, 2, 5) for q in (0, 1)], "doc_id long, quality int")
    for order in ("quality", "-quality"):
        assert quality.fit(docs, whole.orderBy(F.expr(order))) is None  # no document is left with label 1


def test_decontamination_edges(spark, docs, empty):
    items = [(1, PASSAGE), (2, None), (None, "x"), (3, ""), (4, "one two"), (5, PASSAGE.upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contaminated(docs, bench)
    got = {r.doc_id: r["items"] for r in rows.collect()}
    assert got[10] == got[11] == [1, 5] and got[4] == got[5] == [4]
    assert [i for i, x in got.items() if x and i not in (4, 5, 10, 11)] == []
    assert decontaminate.contaminated(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0


def test_quality_edges(spark, docs, empty):
    labels = [(4, 0), (5, 0), (12, 1), (13, 1), (None, 1), (6, None), (12, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    field = quality.fit(docs, table)
    rows = quality.scored(docs, field).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.fit(docs, table.limit(0)) is None
    assert {r.score for r in quality.scored(docs, None).collect()} == {0.5}
    assert quality.scored(empty, field).count() == 0


def test_class_lm_edges(docs, empty):
    rows = {r.doc_id: r for r in class_lm.held_out_scores(docs).collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == rows[3].n_tokens == 1
    assert rows[18].n_tokens == 4  # two rows of one id are summed
    once = [(i, t) for i, t in ROWS if i != 18]
    total = sum(len(brute.words(t)) + 1 for i, t in ROWS if brute.bucket(i, 10))
    assert all(rows[i].train_tokens == total for i, _ in once)
    assert class_lm.held_out_scores(empty).count() == 0


def test_exact_dedup_edges(docs, empty):
    rows = exact_dedup.exact_dedup(docs, counters=2).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    assert got[8].keep_id == got[9].keep_id == -3 and got[9].group_size == 3
    assert got[1].keep_id == got[2].keep_id == 1 and got[3].keep_id == 3
    assert sum(r.doc_id == 18 and r.kept and r.group_size == 2 for r in rows) == 2
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_heavy_hitters_are_found(spark):
    digests = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', string(id)) AS digest")
    found = {r.digest for r in exact_dedup.heavy_candidates(digests.repartition(5), 8).collect()}
    assert "hot" in found and len(found) <= 8


def test_near_duplicate_edges(docs, empty):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS) - 1  # the row without an id
    want = brute.near_duplicates(dict(ROWS).items())
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == want
    assert want[9][1] == -3 and want[14][1] == 12 and want[1] == (0, 1, True)
    assert minhash.near_duplicates(empty).count() == 0


def test_crowded_bucket_links_by_rare_shingles(spark, monkeypatch):
    monkeypatch.setattr("bazaarscope.llm.linking.CROWD", 1)
    shared = " ".join(rng.choice(NAMES, 60))
    rows = []
    for i in range(40):
        own = list(rng.choice(NAMES, 40))
        rows += [(3 * i, " ".join([shared, *own])), (3 * i + 1, " ".join([shared, *own[:-3]]))]
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    want = brute.near_duplicates(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_line_edges(docs, empty):
    rows = line_dedup.dedup_lines(docs)
    assert rows.columns == [*docs.columns, "n_lines", "n_removed"]
    rows = rows.collect()
    assert len(rows) == len(ROWS)
    want = brute.lines(dict(ROWS).items())
    got = {r.doc_id: (r.n_lines, r.n_removed, brute.sha(r.text or "")) for r in rows}
    assert {i: v for i, v in got.items() if i is not None} == {i: v for i, v in want.items() if i is not None}
    assert got[21][1] == 1 and got[2][1] == got[3][1] == 0
    assert [r.text for r in rows if r.doc_id is None] == ["no id at all"]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_pipeline_stages(spark, docs, empty, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    kept = docs
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept.write.parquet(f"{folder}/{name}")
        kept = stage(spark, spark.read.parquet(f"{folder}/{name}"), folder)
        if at < 4:
            assert kept.columns == docs.columns
    rows = kept.collect()
    left = [r.doc_id for r in rows]
    # copies, near copies and the passage go, clean documents and the one without an id stay
    assert not {1, 2, 3, 7, 8, 9, 10, 11, 14, 16} & set(left)
    assert {4, 6, 12, 15, 17, 19, 20, 21, -3, None} <= set(left)
    assert all(r.n_tokens > 0 for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
