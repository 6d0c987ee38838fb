"""Ids of public tokenizer files, fast on whole corpora: every distinct word is encoded once and looked up after.

Both encoders cut a text only where the tokenizer itself always cuts (at a single space, and between a word's letters and
signs), so the ids are those of encoding the whole text; texts where that does not hold go to the tokenizer whole. Words are
named by 64-bit hashes in a bounded table; when it is full it begins anew, which changes no id.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from tokenizers import Tokenizer

from .hashing import SPACES, Table, Words, gather, groups, grown, values
from .shared import mix64

CACHE_WORDS = 1_000_000
CACHE_MARKS = 20_000
# White space other than space and newline.
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_SIGNS = r"[!-&(-/:-@\[-`{-~]+"  # without the apostrophe, which may join what follows
# Words of letters and signs alone; a cut lies between letters and signs, and nowhere else.
_SIMPLE, _PARTS, _LETTER = re.compile(f"(?:{_LETTERS}+|{_SIGNS}+)++"), re.compile(f"{_LETTERS}|{_SIGNS}"), re.compile(_LETTERS)


def _odd(text: str) -> bool:
    return any(map(text.__contains__, _OTHER_SPACE[: 8 if text.isascii() else None]))


class _Cached:
    VALUE, SPACES, BETWEEN = values(), SPACES, "\n"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.marks: dict[str, bytes] = {}
        self.table = Table(CACHE_WORDS)
        # By a word's number: where its ids begin in the pool, and how many they are.
        self.pool, self.starts, self.lengths, self.used = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return next(self.ids_of_each([text])).tobytes()

    def ids_of_each(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        for group in groups(texts):
            regular = [self.regular(t) for t in group]
            words = Words([t if r else "" for t, r in zip(group, regular, strict=True)], self.VALUE, self.SPACES, self.BETWEEN)
            flat, ends = self.encoded(self.hashes(words), lambda at: list(map(self.piece, self.texts(words, at))))
            cuts = np.append(0, ends)[words.first].tolist()
            for text, r, a, b in zip(group, regular, cuts[:-1], cuts[1:], strict=True):
                yield flat[a:b] if r else np.frombuffer(self.whole(text), "<u4")

    def hashes(self, words: Words) -> np.ndarray:
        return words.hash

    def texts(self, words: Words, at: np.ndarray) -> list[str]:
        return [w.decode("utf-8", "replace") for w in words.words(at)]

    def encoded(self, hash_: np.ndarray, pieces: Callable[[np.ndarray], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words with these hashes end to end, and where each word's end. pieces: the ids of the words at these places."""

        def learn(first: int, new: np.ndarray, at: np.ndarray) -> None:
            if not first:
                self.used = 0
            made = pieces(at)
            flat = np.frombuffer(b"".join(made), "<u4")
            last = first + len(made)
            self.pool, self.starts, self.lengths = grown(self.pool, self.used + len(flat)), grown(self.starts, last), grown(self.lengths, last)
            self.pool[self.used : self.used + len(flat)] = flat
            self.lengths[first:last] = np.fromiter(map(len, made), np.int64, len(made)) // 4
            self.starts[first:last] = self.used + np.cumsum(self.lengths[first:last]) - self.lengths[first:last]
            self.used += len(flat)

        numbers = self.table.numbered(hash_, learn)
        lengths = self.lengths[numbers] if len(numbers) else np.empty(0, np.int64)
        return self.pool[gather(self.starts[numbers], lengths)], np.cumsum(lengths)

    def mark(self, signs: str) -> bytes:
        known = self.marks.get(signs)
        if known is None:
            if len(self.marks) > CACHE_MARKS:
                self.marks.clear()
            known = self.marks[signs] = self.whole(signs)
        return known

    def parts(self, word: str) -> list[str] | None:
        """The word's runs of letters and of signs, or None if it has anything else or might hold a special token."""
        return _PARTS.findall(word) if _SIMPLE.fullmatch(word) and "<|" not in word else None


class ByteBpe(_Cached):
    """A byte-level BPE file whose words begin with their space."""

    SPACES, BETWEEN = np.arange(256) == 32, " "

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        model = json.loads(self.tokenizer.to_str())
        to_byte = {c: b for b, c in _byte_letters().items()}
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        # The pattern of byte-level BPE with use_regex; fixed by the tokenizer file's kind.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.merge = self.fast._core_bpe.encode_single_piece
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.little = {i: i.to_bytes(4, "little") for i in ranks.values()}

    def regular(self, text: str) -> bool:
        """Single spaces part the words; so each word's ids are those of the word with its space."""
        return not ("  " in text or text[-1:] == " " or _odd(text))

    def hashes(self, words: Words) -> np.ndarray:
        """A text's first word has no space and so another name."""
        out, first = words.hash, np.flatnonzero(np.isin(words.starts, words.begins[:-1]))
        if len(first):
            out = out.copy()
            out[first] = np.maximum(mix64(out[first] ^ np.uint64(0xD6E8FEB86659FD93)), 1)
        return out

    def texts(self, words: Words, at: np.ndarray) -> list[str]:
        first = np.isin(words.starts[at], words.begins[:-1]).tolist()
        return [t if f else " " + t for t, f in zip(super().texts(words, at), first, strict=True)]

    def piece(self, piece: str) -> bytes:
        word = piece.removeprefix(" ")
        parts = self.parts(word)
        if not parts:
            if self.special and self.special.search(piece):
                return self.whole(piece)
            return b"".join(map(self.little.__getitem__, self.fast.encode_ordinary(piece)))
        parts[0] = piece[: len(piece) - len(word)] + parts[0]
        return b"".join(map(self._run, parts))

    def _run(self, run: str) -> bytes:
        own = self.merge(run.encode())
        return self.little[own[0]] if len(own) == 1 else b"".join([self.little[x] for x in own])


class WordBpe(_Cached):
    """A BPE file with word ends that lower-cases and drops white space."""

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        model = json.loads(self.tokenizer.to_str())["model"]
        vocab, to_byte, end = model["vocab"], {c: b for b, c in _byte_letters().items()}, model["end_of_word_suffix"]
        # A word's end is byte 255, which no UTF-8 text has. It joins the letter before it ahead of every other merge.
        ranks, real = {bytes([b]): b for b in range(256)}, {b: vocab[c] for c, b in to_byte.items()}
        merged = lambda t: bytes(to_byte[c] for c in t.removesuffix(end)) + (b"\xff" if t.endswith(end) else b"")
        for c, b in to_byte.items():
            if b != 255:
                ranks[bytes([b, 255])] = 256 + b
                real[256 + b] = vocab[c + end]
        for n, pair in enumerate(model["merges"]):
            token = "".join(pair if isinstance(pair, list) else pair.split(" "))
            if ranks.setdefault(merged(token), 512 + n) == 512 + n:
                real[512 + n] = vocab[token]
        self.little = {n: i.to_bytes(4, "little") for n, i in real.items()}
        self.merge = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    VALUE = values(lower=True)

    def regular(self, text: str) -> bool:
        """Space and newline part the words, and a text's ids are its words' ids end to end."""
        return not ("<|" in text or _odd(text))

    def piece(self, word: str) -> bytes:
        """The ids of one word (no ASCII white space in it)."""
        if _LETTER.fullmatch(word):
            return self._letters(word)
        parts = self.parts(word)
        if not parts:
            return self.whole(word)
        return b"".join([self._letters(x) if _LETTER.match(x) else self.mark(x) for x in parts])

    def word(self, word: str) -> bytes:
        """The ids of a word that may hold any white space but ASCII's, or a special token."""
        if _LETTER.fullmatch(word):
            return self._letters(word)
        return self.piece(word) if self.regular(word) else self.whole(word)

    def _letters(self, part: str) -> bytes:
        own = self.merge(part.lower().encode() + b"\xff")
        little = self.little
        return little[own[0]] if len(own) == 1 else b"".join([little[x] for x in own])


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE files write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


@functools.cache
def encoder(kind: str, path: str) -> _Cached:
    """One encoder per worker process."""
    return {"byte": ByteBpe, "word": WordBpe}[kind](path)
