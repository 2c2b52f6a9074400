"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its encoding: the one
whose boundary with the encoding of the shorter prefix survives re-merging. The encoder stores
that last token for each prefix. Appending bytes extends the table without touching it, and an
edit only re-encodes from the first changed byte.

A text is cut into units, an optional space and a run of non-space bytes or a run of white space;
the split pattern never matches across them. Units are looked up by a 64-bit id in a bounded
table of known encodings, vectorised over a chunk; only new units run the program.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import prepared, texts
from .words import _BYTE_CODES, SPACE, buffer_of, mapped, mixed, ranged, slices

KNOWN_UNITS = 300_000
KNOWN_PAIRS = 400_000
_SHORT = (3, 2, 1)


class Vocabulary:
    """Ranks, their bytes, the split of each token into its two merged halves."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        # lengths of the tokens that end in the same four bytes, longest first, then 3 to 1
        tails: dict[bytes, set[int]] = {}
        for token in self.ranks:
            if len(token) > 3:
                tails.setdefault(token[-4:], set()).add(len(token))
        self.tails = {t: (*sorted(n, reverse=True), 3, 2, 1) for t, n in tails.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a base token."""
        if token not in self.halves:
            self.halves[token] = self._halved(self.bytes_of[token])
        return self.halves[token]

    def _halved(self, whole: bytes) -> tuple[int, int] | None:
        parts = [self.ranks[whole[i : i + 1]] for i in range(len(whole))]
        if len(parts) < 2:
            return None
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(self.bytes_of[parts[i]] + self.bytes_of[parts[i + 1]])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return None
            parts[at : at + 2] = [best]
        return parts[0], parts[1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their joined bytes are encoded."""
        pair = left << 24 | right
        found = self.fits.get(pair)
        if found is None:
            if len(self.fits) > KNOWN_PAIRS:
                self.fits.clear()
            found = self.fits[pair] = self._apart(left, right)
        return found

    def _apart(self, left: int, right: int) -> bool:
        # undo merges, latest first; a pair across the boundary that would have merged earlier
        # than either side was completed breaks the boundary
        limit = len(self.bytes_of)
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit, parts = left, self.split(left)
                if parts is None:
                    limit, parts = right, self.split(right)
                    if parts is None:
                        return True
                    # equal ranks merge from the left, so a tie keeps the boundary
                    right, limit = parts[0], right + 1
                else:
                    left = parts[1]
            else:
                limit, parts = right + 1, self.split(right)
                if parts is None:
                    limit, parts = left, self.split(left)
                    if parts is None:
                        return True
                    left = parts[1]
                else:
                    right = parts[0]


class PrefixEncoder:
    """The table of last tokens of one piece; supports appends and edits."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b"") -> None:
        self.vocabulary, self.piece = vocabulary, b""
        self.last: list[int] = []  # token that ends the encoding of each prefix
        self.append(piece)

    def append(self, more: bytes) -> PrefixEncoder:
        start, self.piece = len(self.piece), self.piece + more
        v, piece, last = self.vocabulary, self.piece, self.last
        ranks, tails, fits = v.ranks.get, v.tails.get, v.fits.get
        for end in range(start + 1, len(piece) + 1):
            for n in tails(piece[end - 4 : end], _SHORT) if end > 3 else _SHORT:
                begin = end - n
                if begin < 0:
                    continue
                token = ranks(piece[begin:end])
                if token is None:
                    continue
                if not begin:
                    if n > 1 and v.split(token) is None:
                        continue
                    last.append(token)
                    break
                apart = fits(last[begin - 1] << 24 | token)
                if apart or apart is None and v.compatible(last[begin - 1], token):
                    last.append(token)
                    break
        return self

    def edit(self, at: int, removed: int, inserted: bytes) -> PrefixEncoder:
        """Replace ``removed`` bytes at ``at``; prefixes before it keep their tokens."""
        tail = self.piece[at + removed :]
        self.piece, self.last = self.piece[:at], self.last[:at]
        return self.append(inserted + tail)

    def tokens(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def prefix_piece(v: Vocabulary, piece: bytes) -> list[int]:
    whole = v.ranks.get(piece)
    if len(piece) == 1:
        return [whole]
    # tiktoken takes a piece that is itself a token as it is
    return [whole] if whole is not None else PrefixEncoder(v, piece).tokens()


# white space beyond ASCII and the separators on which engines differ
_WIDE_SPACE = regex.compile(r"[\x1c-\x1f\x85\p{Z}--[ ]]", regex.V1)


class UnitTable:
    """Encodings of known units by 64-bit id, at most ``limit`` of them between chunks."""

    def __init__(self, v: Vocabulary, encode: Callable[[Vocabulary, bytes], list[int]], limit: int):
        self.v, self.encode, self.limit = v, encode, limit
        self.clear()

    def clear(self) -> None:
        self.ids = np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _unit(self, unit: bytes) -> list[int]:
        out: list[int] = []
        for piece in self.v.pattern.findall(unit.decode()):
            out += self.encode(self.v, piece.encode())
        return out

    def _learn(self, ids: np.ndarray, units: list[bytes]) -> None:
        coded = [self._unit(u) for u in units]
        n = np.array([len(c) for c in coded], np.int64)
        flat = np.fromiter((t for c in coded for t in c), np.uint32, int(n.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        where = np.searchsorted(self.ids, ids)
        self.ids = np.insert(self.ids, where, ids)
        self.at, self.n = np.insert(self.at, where, at), np.insert(self.n, where, n)

    def positions(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all units of a chunk and the first unit of each document."""
        starts, ends = units(data, offsets)
        first = np.searchsorted(starts, offsets)
        ids = mixed(ranged(_BYTE_CODES[data], starts, ends))
        own, example, inverse = np.unique(ids, return_index=True, return_inverse=True)
        if len(self.ids) > self.limit:
            self.clear()
        where = np.searchsorted(self.ids, own)
        new = np.ones(len(own), bool)
        inside = where < len(self.ids)
        new[inside] = self.ids[where[inside]] != own[inside]
        if new.any():
            self._learn(own[new], [data[starts[i] : ends[i]].tobytes() for i in example[new]])
            where = np.searchsorted(self.ids, own)
        return where[inverse], first

    def tokens(self, rows: np.ndarray) -> np.ndarray:
        """The concatenated tokens of the given table rows."""
        n = self.n[rows]
        skip = np.repeat(self.at[rows] - (np.cumsum(n) - n), n)
        return self.pool[skip + np.arange(len(skip))]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the units: runs of non-space bytes with the single space before them, all but
    the last byte of a longer white-space run, and what is left."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    after = np.append(space[1:], True)  # the next byte is white space or the text ends
    after[edge[1:]] = True
    before = np.insert(space[:-1], 0, False)
    before[edge[:-1]] = False
    glued = space & ~after & (data == 32)  # a space that goes with the next run
    begins = edge[:-1].copy()
    begins |= glued
    begins |= space & ~after  # the last white space before a run stands alone or is glued
    begins |= space & ~before & ~edge[:-1]
    fresh = ~space & before
    fresh[1:] &= ~glued[:-1]
    begins |= fresh
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], len(data))


class Encoder:
    """Encodes the documents of Arrow columns chunk by chunk."""

    def __init__(self, path: str, pattern: str, encode=prefix_piece, limit: int = KNOWN_UNITS):
        self.v = vocabulary(path, pattern)
        self.table = UnitTable(self.v, encode, limit)

    def plain(self, text: str) -> np.ndarray:
        out: list[int] = []
        for piece in self.v.pattern.findall(text):
            out += self.table.encode(self.v, piece.encode())
        return np.array(out, np.uint32)

    def column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The token ids of each document in turn; null counts as empty."""
        data, offsets = buffer_of(column)
        for rows in slices(offsets):
            low = offsets[rows.start]
            own = offsets[rows.start : rows.stop + 1] - low
            part = data[low : offsets[rows.stop]]
            odd = set()
            for d in np.unique(np.searchsorted(own, _suspects(part), "right") - 1).tolist():
                if _WIDE_SPACE.search(part[own[d] : own[d + 1]].tobytes().decode()):
                    odd.add(d)
            where, first = self.table.positions(part, own)
            tokens = self.table.tokens(where)
            sums = np.zeros(len(where) + 1, np.int64)
            np.cumsum(self.table.n[where], out=sums[1:])
            for d in range(len(own) - 1):
                if d in odd:
                    yield self.plain(part[own[d] : own[d + 1]].tobytes().decode())
                else:
                    yield tokens[sums[first[d]] : sums[first[d + 1]]]


def _suspects(part: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII, or an ASCII separator, may begin."""
    following = np.append(part[1:], 0).astype(np.uint8)
    found = (part >= 0x1C) & (part <= 0x1F)
    found |= (part == 0xC2) & ((following == 0x85) | (following == 0xA0))
    found |= (part == 0xE1) & (following == 0x9A)
    found |= (part == 0xE2) & ((following == 0x80) | (following == 0x81))
    found |= (part == 0xE3) & (following == 0x80)
    return np.flatnonzero(found)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process, kept between tasks."""
    return Encoder(path, pattern)


def encode_decode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for,
    the token ids themselves as little-endian unsigned 32-bit ``ids``.

    Ids are decoded again through the vocabulary's bytes. Null texts count as empty (no tokens);
    repeated rows and ids are encoded each for itself; null ids pass through. Map-only: no
    shuffle, memory bounded by one chunk and the table of known units.
    """
    prepared(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        counts, digests, decoded, raw = [], [], [], []
        table = own.v.bytes_of
        for ids in own.column(batch.column("text")):
            counts.append(len(ids))
            binary = ids.astype("<u4").tobytes()
            digests.append(hashlib.sha256(binary).hexdigest())
            back = b"".join([table[i] for i in ids.tolist()])
            decoded.append(hashlib.sha256(back).hexdigest())
            if with_ids:
                raw.append(binary)
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()),
                   pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(mapped(work), kind + (", ids binary" if with_ids else ""))
