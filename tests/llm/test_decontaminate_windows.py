"""Every window of a document is held against the items, wherever it starts."""

from collections import Counter

import numpy as np
import pyarrow as pa

from bazaarscope.llm import decontaminate
from bazaarscope.llm.words import chunks

from . import brute


def _best(text, item):
    """Brute force over every window of the item's size, clipped at the document's edges."""
    own, other = brute.words(text.lower()), brute.words(item.lower())
    width = min(5, len(other))
    grams, bag = ([tuple(w[k : k + width]) for k in range(len(w) - width + 1)] for w in (own, other))
    size, bag = len(bag), Counter(bag)
    found = 0.0
    for p in range(1 - size, len(grams)):
        window = Counter(grams[max(p, 0) : max(p + size, 0)])
        both = sum((window & bag).values())
        found = max(found, both / (sum(window.values()) + size - both))
    return found


def _found(docs, items):
    block = decontaminate.index_items(items)
    return {
        (chunk.rows.start + d, block.item_ids[i]): value
        for chunk in chunks(pa.array(docs, pa.string()))
        for (d, i), value in decontaminate.matches(chunk, block).items()
    }


def _brute(docs, items):
    values = {(d, k): _best(text, item) for d, text in enumerate(docs) for k, item in items}
    return {pair: value for pair, value in values.items() if 100 * value >= 75}


def test_edited_copies_at_any_place_are_found_with_their_best_window():
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)]
    items = [(k, " ".join(rng.choice(names, n))) for k, n in enumerate([3, 6, 9, 20, 40, 80, 160])]
    docs = []
    for _, item in items:
        for place in (0, 1, 3, 7, 13, 22, 29, 35, 44, 58):
            words = item.split()
            # typos, words put in and left out: similarity around three quarters
            for _ in range(len(words) // 35 + (place % 2)):
                at = rng.integers(len(words))
                words[at : at + rng.integers(2)] = ["typo"] * int(rng.integers(2))
            before, after = rng.choice(names, place), rng.choice(names, int(rng.integers(60)))
            docs.append(" ".join([*before, *words, *after]))
            docs.append(" ".join([*after, *words[len(words) // 6 :], *before]))
    want = _brute(docs, items)
    assert len(want) > 40 and sum(value < 0.85 for value in want.values()) > 5
    assert _found(docs, items) == want


def test_repeated_shingles_and_shared_ones_count_as_often_as_the_item_has_them():
    rng = np.random.default_rng(6)
    items = [(0, "a a a a a a a a a b c d"), (1, "x y " * 12), (2, "a b"), (3, "z"),
             (4, "common start of all items then one"), (5, "common start of all items then two")]
    docs = [" ".join(rng.choice(list("abcdxyz"), int(n), p=[.4, .1, .05, .05, .2, .15, .05]))
            for n in rng.integers(0, 60, 60)]
    docs += ["a " * 9 + "b c d", "a " * 30, "q " + "x y " * 12, "x y " * 11 + "x", "y x " * 13,
             "so common start of all items then two is", "common start of all items then", "", None]
    assert _found(docs, items) == _brute([d or "" for d in docs], items)


def test_no_documents_no_items():
    assert _found([], [(0, "a b c")]) == {} and _found(["a b c"], []) == {}
    assert _found([None, "", " "], [(0, "a b c"), (1, ""), (None, "a")]) == {}
