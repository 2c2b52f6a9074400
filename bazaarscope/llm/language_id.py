"""Language ID by hierarchical discrimination.

A linear SVM per family (one against the rest) picks the language family; within it one-versus-one
linear SVMs vote on the language. Features are hashed byte 3- and 4-grams of the lower-cased text,
so a prediction is two table look-ups per byte, summed per document in one map-only pass.

The score compares the learned languages with each other, so it says nothing about a text in none
of them. ``claim`` does: the mean of log2 of each gram's probability in the labelled sample over
its probability among evenly spread grams, above a floor fitted on the sample. Grams with a
digit or a sign are of no language and do not count for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, prepared, texts
from .words import SPACE, buffer_of, mapped, slices

# fixed values: families of ISO 639-1 codes; a code not listed is a family of its own
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "uralic": ("et", "fi", "hu"),
}
UNKNOWN = "und"
SLOTS = 1 << 16
PER_LANGUAGE = 400  # expected labelled documents per language that the fit reads
_EPOCHS = 6
_REGULAR = 1e-4
_STEEPNESS = 4.0
LEAST_SAMPLE = 100  # labelled texts below which no floor can be fitted and every letter is claimed
_LOW = 0.005  # share of labelled texts that may lie below the clean end
_SLACK = 2.0  # standard errors of a text's mean by which it may fall short of the floor

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[SPACE] = 32
_PROSE = np.zeros(256, bool)
_PROSE[[32, *range(97, 123), *range(128, 256)]] = True


def grams(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Slots of the 3- and 4-gram at each byte; 0 where one would leave its document."""
    folded = np.append(_FOLD[data], np.zeros(3, np.uint32))
    n = len(data)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    base = folded[:n] | folded[1 : n + 1] << np.uint32(8) | folded[2 : n + 2] << np.uint32(16)
    out = []
    for width, value in ((3, base), (4, base | folded[3 : n + 3] << np.uint32(24))):
        with np.errstate(over="ignore"):
            mixed = value * np.uint32(0x9E3779B1) + np.uint32(width * 0x1000193)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        slot = (mixed >> np.uint32(16)).astype(np.int64)
        slot[left < width] = 0
        out.append(slot)
    return out


def prose(data: np.ndarray, slots: list[np.ndarray]) -> list[np.ndarray]:
    """``slots`` of ``grams`` with 0 also where a gram holds more than letters and spaces."""
    other = np.zeros(len(data) + 4, np.int64)
    np.cumsum(~_PROSE[_FOLD[data]], out=other[1 : len(data) + 1])
    other[len(data) + 1 :] = other[len(data)]
    n = len(data)
    return [np.where(other[w : n + w] > other[:n], 0, x) for w, x in zip((3, 4), slots)]


@dataclass
class Claim:
    """``bits`` by slot: log2 of a gram's share in the sample over an even share. A text of n
    grams is claimed from ``floor - slack / sqrt(n)`` mean bits on."""

    bits: np.ndarray
    floor: float
    slack: float

    def above(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Mean bits above the floor; a text without any gram of letters is not judged."""
        most = np.maximum(n, 1)
        return np.where(n > 0, total / most - self.floor + self.slack / np.sqrt(most), 0.0)


def _bits(total: np.ndarray) -> np.ndarray:
    share = total / max(1e-12, total.sum())
    bits = np.log2((share * SLOTS + 0.1) / 1.1)
    bits[0] = 0
    return bits.astype(np.float32)


def fit_claim(labels: list[str], rows: list[tuple[np.ndarray, np.ndarray]]) -> Claim:
    """The floor lies midway between the low end of clean texts, each half of the sample read with
    the grams of the other, and the usual text of a language read with those of all others (an
    even spread of grams, 0 bits, if there is one language only)."""
    names = sorted(set(labels))
    totals = np.zeros((len(names), 2, SLOTS))
    for i, (label, (at, n)) in enumerate(zip(labels, rows)):
        totals[names.index(label), i % 2, at] += n / max(1, n.sum())
    # every language weighs the same
    totals /= np.maximum(totals.sum(axis=(1, 2), keepdims=True), 1e-12)
    bits = _bits(totals.sum(axis=(0, 1)))
    full = [i for i, (at, _) in enumerate(rows) if len(at)]
    if len(full) < LEAST_SAMPLE:
        return Claim(bits, -np.inf, 0.0)

    def mean(i: int, with_bits: np.ndarray) -> float:
        return float(with_bits[rows[i][0]] @ rows[i][1] / rows[i][1].sum())

    halves = [_bits(totals[:, 1 - h].sum(axis=0)) for h in (0, 1)]
    clean = np.array([mean(i, halves[i % 2]) for i in full])
    spread = np.array([
        np.sqrt(max(0.0, mean(i, halves[i % 2] ** 2) - m * m)) for i, m in zip(full, clean)
    ])
    low, foreign = float(np.quantile(clean, _LOW)), [0.0]
    if len(names) > 1:
        foreign = []
        for k, name in enumerate(names):
            others = _bits(np.delete(totals, k, axis=0).sum(axis=(0, 1)))
            own = [mean(i, others) for i in full if labels[i] == name]
            foreign += [float(np.median(own))] if own else []
    floor = (low + min(low, float(np.mean(foreign)))) / 2
    return Claim(bits, floor, _SLACK * float(np.median(spread)))


@dataclass
class Model:
    """``weights`` has a row per slot; columns are the families, then the language pairs."""

    families: list[str]
    languages: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]
    weights: np.ndarray
    claim: Claim | None = None

    @property
    def all_languages(self) -> list[str]:
        return sorted(x for members in self.languages.values() for x in members)

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into ``all_languages`` and score in 0..1 for each row of mean margins."""
        names = self.all_languages
        n = len(margins)
        best, score = np.zeros(n, np.int64), np.zeros(n)
        powers = np.exp(_STEEPNESS * np.clip(margins[:, : len(self.families)], -8, 8))
        shares = powers / powers.sum(axis=1, keepdims=True)
        chosen = shares.argmax(axis=1)
        for f, family in enumerate(self.families):
            rows, members = np.flatnonzero(chosen == f), self.languages[family]
            votes = np.zeros((len(rows), len(members)))
            trust = np.ones((len(rows), len(members)))
            for p, (of, a, b) in enumerate(self.pairs):
                if of == family:
                    m = margins[rows, len(self.families) + p]
                    chance = 1 / (1 + np.exp(-_STEEPNESS * np.clip(m, -8, 8)))
                    i, j = members.index(a), members.index(b)
                    # a whole vote for the winner; margins only break ties
                    votes[:, i] += (m >= 0) + chance * 1e-3
                    votes[:, j] += (m < 0) + (1 - chance) * 1e-3
                    trust[:, i] = np.minimum(trust[:, i], chance)
                    trust[:, j] = np.minimum(trust[:, j], 1 - chance)
            winner = votes.argmax(axis=1)
            best[rows] = np.array([names.index(x) for x in members])[winner]
            score[rows] = shares[rows, f] * trust[np.arange(len(rows)), winner]
        return best, score


def _counts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data, offsets = buffer_of(batch.column("text"))
    slots, values, told, numbers = [], [], [], []
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        own = grams(data[lo:hi], np.array([0, hi - lo]))
        both = np.concatenate(own)
        at, n = np.unique(both[both > 0], return_counts=True)
        slots.append(at)
        values.append(n / max(1, n.sum()))
        both = np.concatenate(prose(data[lo:hi], own))
        at, n = np.unique(both[both > 0], return_counts=True)
        told.append(at)
        numbers.append(n)
    whole = pa.list_(pa.int64())
    yield pa.RecordBatch.from_arrays(
        [batch.column("lang"), pa.array(slots, whole), pa.array(values, pa.list_(pa.float64())),
         pa.array(told, whole), pa.array(numbers, whole)],
        names=["lang", "slots", "shares", "told", "numbers"],
    )


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int) -> np.ndarray:
    """Averaged Pegasos with balanced classes over unit-length sparse rows, without a bias."""
    rng = np.random.default_rng(7)
    weight, total, step = np.zeros(size), np.zeros(size), 0
    positive, negative = np.flatnonzero(signs > 0), np.flatnonzero(signs < 0)
    if not len(positive) or not len(negative):
        return np.full(size, 0.0)
    half = max(len(positive), len(negative))
    for _ in range(_EPOCHS):
        order = np.ravel(np.column_stack([rng.choice(positive, half), rng.choice(negative, half)]))
        for i in order:
            step += 1
            rate = 1 / (_REGULAR * (step + 1000))
            at, value = rows[i]
            short = signs[i] * (weight[at] @ value) < 1
            weight *= 1 - rate * _REGULAR
            if short:
                weight[at] += rate * signs[i] * value
            if step % 16 == 0:
                total += weight
    return total


_DRAWS = 1 << 62


def draws_taken(n: int, per_language: int) -> int:
    """How many of ``_DRAWS`` hash values draw a row, so that about ``per_language`` of ``n`` rows are
    drawn; never 0 below 1.8e21 rows."""
    return min(_DRAWS, per_language * _DRAWS // n)


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, families: dict[str, tuple[str, ...]] = FAMILIES,
) -> Model:
    """Fit on a sample of labelled rows: about ``per_language`` of each language.

    Rows are drawn by a hash of the id at a rate taken from the language's count, so the sample
    stays bounded and the same on every run. Null labels and texts are left out.
    """
    prepared(docs.sparkSession)
    known = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not counts:
        return Model([], {}, [], np.zeros((SLOTS, 0), np.float32))
    draw = F.shiftrightunsigned(F.xxhash64(docs[id_col]), 2)
    rate = F.create_map(*[
        x for k, n in counts.items()
        for x in (F.lit(k), F.lit(draws_taken(n, per_language)).cast("long"))
    ])
    sample = known.where(draw < rate[docs[lang_col]]).select(
        docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"),
        docs[id_col].alias("doc_id"),
    )
    rows = sample.select("lang", "text").mapInArrow(
        mapped(_counts),
        "lang string, slots array<long>, shares array<double>, told array<long>, numbers array<long>",
    ).toArrow()
    labels = rows.column("lang").to_pylist()
    sparse = []
    for at, share in zip(rows.column("slots"), rows.column("shares")):
        at, share = np.array(at.as_py(), np.int64), np.array(share.as_py())
        sparse.append((at, share / max(1e-12, np.linalg.norm(share))))
    order = sorted(range(len(labels)), key=lambda i: (labels[i], len(sparse[i][0]), sparse[i][1].sum()))
    labels, sparse = [labels[i] for i in order], [sparse[i] for i in order]
    told = [np.array(rows.column("told")[i].as_py(), np.int64) for i in order]
    numbers = [np.array(rows.column("numbers")[i].as_py(), np.int64) for i in order]
    claim = fit_claim(labels, list(zip(told, numbers)))

    of = {code: name for name, codes in families.items() for code in codes}
    languages: dict[str, list[str]] = {}
    for code in sorted(counts):
        languages.setdefault(of.get(code, code), []).append(code)
    names = sorted(languages)
    pairs = [(f, a, b) for f in names for a, b in combinations(languages[f], 2)]
    label, family = np.array(labels), np.array([of.get(x, x) for x in labels])
    columns = [np.where(family == f, 1, -1) for f in names]
    columns += [np.where(label == a, 1, np.where(label == b, -1, 0)) for _, a, b in pairs]
    weights = np.zeros((SLOTS, len(columns)), np.float32)
    for c, signs in enumerate(columns):
        w = _svm(sparse, signs, SLOTS)
        own = [i for i in range(len(sparse)) if signs[i]]
        # unit: the mean margin of a training text over its share of each gram
        means = [abs(w[sparse[i][0]] @ sparse[i][1]) / max(1e-12, sparse[i][1].sum()) for i in own]
        weights[:, c] = w / max(1e-12, float(np.mean(means or [1])))
    weights[0] = 0
    return Model(names, languages, pairs, weights, claim)


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
    claims: bool = False,
) -> DataFrame:
    """``lang_pred`` and ``score`` beside the untouched columns of ``docs``; no shuffle. With
    ``claims`` also ``claim``: below 0 where the text is in none of the learned languages.

    Null texts and texts without a letter get ``und`` and score 0. Columns of ``docs`` that bear
    the names of the results are replaced.
    """
    prepared(docs.sparkSession)
    names = [*model.all_languages, UNKNOWN]
    added = ["lang_pred", "score", "claim"] if claims else ["lang_pred", "score"]
    claims = claims and model.claim is not None
    kept = [c for c in docs.columns if c not in added]
    plain = docs.select(*kept)
    letters = F.coalesce(plain[text_col].rlike(r"\p{L}"), F.lit(False))
    known = plain.withColumn("__letters", letters)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = buffer_of(batch.column(text_col))
        margins = np.zeros((batch.num_rows, model.weights.shape[1]))
        claim = np.zeros(batch.num_rows)
        for rows in slices(offsets):
            low, high = offsets[rows.start], offsets[rows.stop]
            own = offsets[rows.start : rows.stop + 1] - low
            sums = np.zeros((high - low + 1, model.weights.shape[1]))
            seen = np.zeros(rows.stop - rows.start)
            slots = grams(data[low:high], own)
            if claims:
                bits, told = np.zeros(high - low + 1), np.zeros(high - low + 1)
                for slot in prose(data[low:high], slots):
                    bits[1:] += np.cumsum(model.claim.bits[slot], dtype=np.float64)
                    told[1:] += np.cumsum(slot > 0)
                claim[rows] = model.claim.above(bits[own[1:]] - bits[own[:-1]], told[own[1:]] - told[own[:-1]])
            for slot in slots:
                np.cumsum(model.weights[slot], axis=0, out=sums[1:], dtype=np.float64)
                margins[rows] += sums[own[1:]] - sums[own[:-1]]
                seen += np.add.reduceat(np.append(slot > 0, False).astype(np.int64), own[:-1]) * (own[1:] > own[:-1])
            margins[rows] /= np.maximum(seen, 1)[:, None]
        letter = batch.column("__letters").to_numpy(zero_copy_only=False)
        if model.families:
            best, score = model.decide(margins)
        else:
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            letter = np.zeros(batch.num_rows, bool)
        best = np.where(letter, best, len(names) - 1)
        results = [pa.array([names[i] for i in best], pa.string()),
                   pa.array(np.where(letter, score, 0.0)), pa.array(claim)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), *results[: len(added)]], names=[*kept, *added]
        )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    kinds = ", ".join(["lang_pred string", "score double", "claim double"][: len(added)])
    return known.mapInArrow(mapped(work), f"{fields}, {kinds}")


def held_out_query(docs: DataFrame) -> DataFrame:
    """Fit on the rows whose bucket modulo 4 is not 2, predict every row."""
    held = bucket(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held))
    rows = predict(texts(docs), model)
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score")
