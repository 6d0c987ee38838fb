"""Words of whole batches of texts as numpy arrays: where they begin and end, 64-bit hashes, numbers from a hash table.

A word's hash is a polynomial over its bytes (each byte stands for a fixed random 64-bit value) modulo 2^64, mixed; words
longer than LONG bytes are hashed by xxh3. It is taken from prefix sums, so no word becomes a Python object.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import xxhash

from .shared import mix64

BLOCK = 1 << 17
LONG = 1000
GROUP_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
_FIRST = np.uint64(0xD6E8FEB86659FD93)

#: White space between words: space and tab to carriage return.
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def values(lower: bool = False) -> np.ndarray:
    """What each byte stands for; with `lower`, A-Z as a-z."""
    out = _VALUES.copy()
    if lower:
        out[65:91] = out[97:123]
    return out


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        step = np.full(BLOCK + LONG + 2, base, np.uint64)
        step[0] = 1
        both.append(np.cumprod(step))
    return both[0], both[1]


def spans(raw: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of raw (bytes) begin and end."""
    inside = np.zeros(len(raw) + 2, bool)
    np.logical_not(spaces[raw], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One hash, never 0, for each word raw[start:end]; the words lie in ascending order."""
    power, inverse = _powers()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        a = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, a + BLOCK, side="right")))
        piece = raw[a : int(ends[stop - 1])][: BLOCK + LONG + 1]  # longer only for a single word, which is hashed below
        sums = np.zeros(len(piece) + 1, np.uint64)
        terms = value[piece]
        terms *= power[: len(piece)]
        np.cumsum(terms, out=sums[1:])
        s, e = starts[at:stop] - a, np.minimum(ends[at:stop] - a, len(piece))
        out[at:stop] = (sums[e] - sums[s]) * inverse[s]
        at = stop
    out = mix64(out)
    for n in np.flatnonzero(ends - starts > LONG).tolist():
        out[n] = xxhash.xxh3_64_intdigest(value[raw[starts[n] : ends[n]]].tobytes())
    out[out == 0] = 1
    return out


def groups(texts: list[str], limit: int = GROUP_BYTES) -> Iterator[list[str]]:
    """The texts in runs of about `limit` characters, so that what is held at once stays small."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


class Words:
    """The words of a group of texts: raw bytes, starts, ends, hashes; words of text n are first[n] .. first[n + 1] - 1."""

    def __init__(self, texts: list[str], value: np.ndarray, spaces: np.ndarray = SPACES, between: str = "\n"):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = between.encode().join(parts)
        self.raw = np.frombuffer(self.data, np.uint8)
        self.starts, self.ends = spans(self.raw, spaces)
        self.hash = hashes(self.raw, self.starts, self.ends, value)
        self.begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.first = np.searchsorted(self.starts, self.begins)

    def words(self, at: np.ndarray) -> list[bytes]:
        """The words at these places."""
        data = self.data
        return [data[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


class Table:
    """Numbers for 64-bit hashes (0 is none), as they come; open addressing over numpy arrays."""

    def __init__(self, most: int):
        self.most = most
        self.bits = max(4, (2 * most - 1).bit_length())
        self.clear()

    def clear(self, room: int = 0) -> None:
        """Forget all; there is room for `most` or, if that is more, `room`."""
        if room > self.most:
            self.most, self.bits = room, (2 * room - 1).bit_length()
        self.keys, self.number, self.size = np.zeros(1 << self.bits, np.uint64), np.empty(1 << self.bits, np.int32), 0

    def _slots(self, hash_: np.ndarray) -> np.ndarray:
        return (hash_ >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hash_: np.ndarray) -> np.ndarray:
        """The hashes' numbers, -1 where there is none."""
        out, at = np.full(len(hash_), -1, np.int32), self._slots(hash_)
        left: np.ndarray | None = None
        while len(at):
            key = self.keys[at]
            hit = key == hash_
            out[hit if left is None else left[hit]] = self.number[at[hit]]
            on = np.flatnonzero(~hit & (key != 0))
            left = on if left is None else left[on]
            hash_, at = hash_[on], (at[on] + 1) & (len(self.keys) - 1)
        return out

    def numbered(self, hash_: np.ndarray, learn) -> np.ndarray:
        """The hashes' numbers. learn(first, new, at) is told of hashes first met: their first number, the hashes (numbered in
        this order), and where in hash_ each is. A table without room for them forgets all others first."""
        out = self.find(hash_)
        miss = np.flatnonzero(out < 0)
        if not len(miss):
            return out
        new, at = np.unique(hash_[miss], return_index=True)
        if self.size + len(new) > self.most:
            miss = np.arange(len(hash_))
            new, at = np.unique(hash_, return_index=True)
            self.clear(len(new))
        first = self.size
        self.add(new)
        learn(first, new, miss[at])
        out[miss] = self.find(hash_[miss])
        return out

    def add(self, new: np.ndarray) -> None:
        """Numbers size, size + 1, ... for distinct hashes that the table does not hold; room for them must be there."""
        number, at = np.arange(self.size, self.size + len(new), dtype=np.int32), self._slots(new)
        self.size += len(new)
        while len(new):
            free = self.keys[at] == 0
            self.keys[at[free]] = new[free]
            won = free & (self.keys[at] == new)
            self.number[at[won]] = number[won]
            new, number, at = new[~won], number[~won], (at[~won] + 1) & (len(self.keys) - 1)


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n entries."""
    if len(x) >= n:
        return x
    out = np.empty(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts .. starts + lengths - 1 of each, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
