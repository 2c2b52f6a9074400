"""Cases in which an operator once did less than its whole job."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from bazaarscope.llm import decontaminate, line_dedup
from bazaarscope.llm.words import chunks

from . import brute

rng = np.random.default_rng(11)


def test_language_stage_rejects_what_no_language_claims(spark):
    parts = {
        "en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as".split(),
        "de": "en er ch de ei un te in ie ge sch ung ver be au st und ich zu auf mit keit".split(),
        "fr": "es le de en re nt on er ou la eau que les ment ai eu tre vi au elle ier ux".split(),
        "es": "que ci os ar es do la mente ra por las jo ez ida cu llo as el un osa rro".split(),
        "fi": "kk aa ii yy oi uo sta llä ssä tt mm jää hyv pää kuu vaa lle nnu yhd".split(),
    }

    def text(lang, n):
        return " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(n))

    rows = [(i, text(lang, 60), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 60)]
    letters = list("abcdefghijklmnopqrstuvwxyz")
    gone = [text("fi", 60) for _ in range(5)]
    gone += [" ".join("".join(rng.choice(letters, 6)) for _ in range(40)) for _ in range(5)]
    # mixed, short, shouted and among numbers: low confidence, yet in learned languages
    stay = [f"{text('en', 30)} {text('es', 30)}", text("de", 4), text("fr", 40).upper(),
            f"{text('en', 6)} 4439606983854503 41.244.73.125 {text('en', 6)} +1 (777) 555-7427"]
    extra = [*gone, *stay]
    # ids of the held-out bucket: nothing is learned from these texts
    free = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows += [(i, t, "en") for i, t in zip(free, extra)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = {r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs, "").collect()}
    assert len(left & set(range(240))) >= 238
    assert not left & set(free[: len(gone)])
    assert set(free[len(gone) : len(extra)]) <= left


def test_line_signatures_do_not_depend_on_spaces_or_length(spark):
    wide = "".join(chr(c) for c in rng.integers(0x4E00, 0x9F00, 300))
    tabbed = "\t".join("".join(rng.choice(list("abcdefgh"), 9)) for _ in range(40))
    solid = "".join(rng.choice(list("ABCDEFGHIJKLMNOPqrstuvwxyz0123456789+/"), 400))
    spaced = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60))
    texts = ["=" * 100, "=" * 200, "-" * 127, "-" * 400, "ab" * 40, "ab" * 300, "abc", "abcd", "abc"]
    for line in (wide, tabbed, solid, spaced):
        at = len(line) // 2
        texts += [line, f"{line[:at]}#{line[at + 1:]}", f"{line[:40]}#{line[41:at]}{line[at + 9:]}"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.report(docs).collect()}
    assert got == brute.lines(rows)
    assert sum(n for _, n, _ in got.values()) == 12


def test_spaced_long_lines_with_scattered_typos(spark):
    rows = []
    for i in range(400):
        line = list(" ".join("".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(40)))
        rows.append((2 * i, "".join(line)))
        for at in np.linspace(4, len(line) - 5, 5).astype(int):  # similarity about 0.8
            line[at] = "#"
        rows.append((2 * i + 1, "".join(line)))
    want = brute.lines(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.report(docs).collect()}
    linked = [i for i in want if want[i][1]]
    assert len(linked) >= 390
    assert sum(got[i] != want[i] for i in linked) <= 2


def _leaks_clipped(text, item):
    """Brute force over every window of the item's size, clipped at the document's edges."""
    own, other = brute.words(text.lower()), brute.words(item.lower())
    width = min(5, len(other))
    grams, bag = ([tuple(w[k : k + width]) for k in range(len(w) - width + 1)] for w in (own, other))
    size, bag = len(bag), Counter(bag)
    for p in range(1 - size, len(grams)):
        window = Counter(grams[max(p, 0) : max(p + size, 0)])
        both = sum((window & bag).values())
        if 100 * both >= 75 * (sum(window.values()) + size - both):
            return True
    return False


def test_items_cut_short_are_found_in_documents_shorter_than_they_are():
    names = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)]
    items = [(k, " ".join(rng.choice(names, n))) for k, n in
             enumerate([5, 6, 7, 8, 10, 12, 20, 24, 37, 37, 41, 60, 90, 150, 300])]
    docs = []
    for _, item in items:
        w = item.split()
        docs += [" ".join(w[a : len(w) - b]) for a in (0, 1, 2, 6) for b in (0, 1, 2, 9)]
        cut = w[: len(w) - len(w) // 6]
        docs += [" ".join(["junk", *cut]), " ".join([*cut[: len(cut) // 2], "typo", *cut[len(cut) // 2 + 1 :]])]
    block = decontaminate.index_items(items)
    got = set()
    for chunk in chunks(pa.array(docs)):
        got |= {(chunk.rows.start + d, block.item_ids[i]) for d, i in decontaminate.matches(chunk, block)}
    shorter = {(d, k) for d, t in enumerate(docs) for k, item in items if len(t.split()) < len(item.split())}
    want = {(d, k) for d, k in shorter if _leaks_clipped(docs[d], items[k][1])}
    assert len(want) > 60
    assert got & shorter == want
    assert {(16 * k + 2 * k, k) for k, _ in items} <= got  # and whole items as before


def test_copy_with_blank_lines_goes_with_all_its_lines(spark):
    text = "first paragraph of it\n\nsecond one, quite other words\n \t\n\nthird and last\n"
    rows = [(1, text), (2, text), (3, "\n\nblank lines and a line of its own"), (4, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert left == {1, 3, 4}  # a text that lost no line stays as it is
