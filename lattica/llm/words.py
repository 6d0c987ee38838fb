"""Words of a text as bytes, and rolling hashes over them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

from .hashing import Words, groups, values
from .shared import mix64

# ASCII letters and digits stay, ASCII signs and controls become spaces, bytes of other letters stay.
_SIGNS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_PUNCTUATION = re.compile("[\u2000-\u206f]")
_LOWER, _EXACT = values(lower=True), values()
_SIGN = np.frombuffer(_SIGNS, np.uint8) == 32


def _plain(text: str) -> str:
    raw = text.lower()
    return raw if raw.isascii() else _PUNCTUATION.sub(" ", raw)


def plain_words(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation or the general punctuation block."""
    return _plain(text).encode("utf-8", "surrogatepass").translate(_SIGNS).split()


def plain_groups(texts: Iterable[str]) -> Iterator[Words]:
    """The plain words of the texts, in groups of texts."""
    for group in groups(texts):
        yield Words([_plain(t) for t in group], _EXACT, _SIGN)


def roll(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` consecutive words."""
    out = hashes[: len(hashes) - width + 1].copy()
    for j in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - width + 1 + j]
    return mix64(out)


def shingle_sets(texts: Iterable[str], width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 64-bit hashes of the word shingles, words being what stands between ASCII white space,
    A-Z lower-cased; the whole sequence as one where words are fewer; none without words."""
    for group in groups(texts):
        words = Words(group, _LOWER)
        rolled = roll(words.hash, width) if len(words.hash) >= width else words.hash
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= width:
                s = np.sort(rolled[a : b - width + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            else:
                yield roll(words.hash[a:b], b - a) + np.uint64(width - (b - a)) if b > a else np.empty(0, np.uint64)


def shingle_set(text: str, width: int) -> np.ndarray:
    return next(shingle_sets([text], width))
