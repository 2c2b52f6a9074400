"""Plain Python versions of the corpus operators for small inputs."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text, fold=False):
    text = text or ""
    return WORD.findall(text.translate(FOLD) if fold else text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def bucket(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


class Union:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def root(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def shingles(tokens, width=5):
    if not tokens:
        return frozenset()
    if len(tokens) < width:
        return frozenset([tuple(tokens)])
    return frozenset(tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1))


def similar_pairs(sets, percent):
    """All pairs of keys whose sets reach the similarity."""
    held, both = collections.defaultdict(list), collections.Counter()
    for key, own in sets.items():
        for x in own:
            for other in held[x]:
                both[other, key] += 1
            held[x].append(key)
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            yield a, b


def near_duplicates(docs):
    sets = {i: shingles(words(t, True)) for i, t in docs if i is not None}
    union = Union(sets)
    for a, b in similar_pairs(sets, 75):
        union.link(a, b)
    return {i: (len(s), union.root(i), union.root(i) == i) for i, s in sets.items()}


def substrings(docs, width=50):
    seen, out = {}, {}
    for i, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        own = words(text)
        gone = [False] * len(own)
        for p in range(len(own) - width + 1):
            if seen.setdefault(tuple(own[p : p + width]), i) < i:
                gone[p : p + width] = [True] * width
        left = " ".join(w for w, g in zip(own, gone) if not g)
        out[i] = (len(own), sum(gone), sha(left))
    return out


def lines(docs):
    places = collections.defaultdict(list)
    for i, text in docs:
        if i is not None:
            for p, line in enumerate((text or "").split("\n")):
                if line.strip(" "):
                    places[line].append((i, p))
    sets = {
        line: frozenset(line[k : k + 5] for k in range(max(1, len(line) - 4))) for line in places
    }
    union = Union(places)
    for a, b in similar_pairs(sets, 80):
        union.link(a, b)
    groups = collections.defaultdict(set)
    for line, at in places.items():
        groups[union.root(line)].update(at)
    gone = collections.defaultdict(set)
    for at in groups.values():
        for i, p in sorted(at)[1:]:
            gone[i].add(p)
    out = {}
    for i, text in docs:
        own = [] if text is None else text.split("\n")
        left = "\n".join(x for p, x in enumerate(own) if p not in gone[i])
        out[i] = (len(own), len(gone[i]), sha(left))
    return out


def leaks(docs, items):
    bags = {}
    for item, text in items:
        own = words((text or "").lower())
        if own:
            width = min(5, len(own))
            grams = [tuple(own[k : k + width]) for k in range(len(own) - width + 1)]
            bags[item] = (width, collections.Counter(grams))
    out = {}
    for i, text in docs:
        own, found = words((text or "").lower()), []
        for item, (width, bag) in bags.items():
            grams = [tuple(own[k : k + width]) for k in range(len(own) - width + 1)]
            size = sum(bag.values())
            if not set(grams) & set(bag) or len(grams) < size:
                continue
            for p in range(len(grams) - size + 1):
                window = collections.Counter(grams[p : p + size])
                both = sum((window & bag).values())
                if 100 * both >= 75 * (2 * size - both):
                    found.append(item)
                    break
        out[i] = sorted(found)
    return out


def base_scores(docs):
    tokens = {i: [*words(t, True), None] for i, t in docs}
    counts = collections.Counter()
    for i, own in tokens.items():
        if bucket(i, 10):
            counts.update(own)
    n, kinds = sum(counts.values()), len(counts)
    return {
        i: (
            bucket(i, 10) == 0, len(own), sum(counts[w] > 0 for w in own), n,
            sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (kinds + 1))) for w in own),
        )
        for i, own in tokens.items()
    }
