"""Personal data: rule spans, and a semi-Markov conditional random field that adds spans around them.

Rules give base spans (emails, IPv4 addresses, card numbers, phone numbers), as code points, exactly as their patterns say.
The model sees zones: stretches of text around digits and at-signs, cut into tokens (runs of letters or digits, white space,
single signs). A segment is up to MOST_TOKENS tokens; features of the whole segment (its shape, length in digits, separators,
check digit, number ranges, what stands beside it) score it for each kind, single tokens outside any entity score 0, and
dynamic programming over boundaries and kinds gives the best segmentation and each segment's posterior. Segments at or above
POSTERIOR that touch no base span are added.

It is trained here, by gradient ascent on the log-likelihood, from the base spans of a bounded sample of zones (SAMPLE_ZONES,
in the order of a hash of the id) and from rewritten copies of them: phones without their plus or country code, cards with
other separators, emails with spaces around the at-sign.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed_texts

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 16
POSTERIOR = 0.95
SAMPLE_DOCS = 4000
SAMPLE_ZONES = 800
EPOCHS = 12
SHAPES = 2048

_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A leftmost address always begins where its run of digits does, so the look-behind changes no match.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if n % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, in one pass: of the signs before an at-sign all belong to it, and its host fits or does not."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _EMAIL_SIGNS:
            begin -= 1
        host = _HOST.match(text, at + 1) if begin < at else None
        if host:
            free = host.end()
            yield begin, free
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= len(m[0]) <= 64 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and at-signs, to the white space beside them; stretches one space apart are one."""
    begin = end = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        a, b = m.span()
        while a and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if end >= 0 and a <= end + 1:
            end = b
            continue
        if end >= 0:
            yield begin, end
        begin, end = a, b
    if end >= 0:
        yield begin, end


def _shape(s: str) -> str:
    kinds = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", s))
    return re.sub(r"\s+", " ", kinds)


def segment_features(text: str, a: int, b: int) -> list[int]:
    """Feature numbers of text[a:b] as one segment."""
    s = text[a:b]
    d = _digits(s)
    left = text[a - 1] if a else " "
    right = text[b] if b < len(text) else " "
    named = [
        "bias", f"digits{min(len(d), 20)}", f"dots{min(s.count('.'), 4)}", f"at{min(s.count('@'), 2)}", f"sep{min(s.count('-') + s.count(' '), 6)}",
        f"first{'+' if s[0] == '+' else '(' if s[0] == '(' else 'd' if s[0].isdigit() else 'a' if s[0].isalpha() else 'x'}",
        f"last{'d' if s[-1].isdigit() else 'a' if s[-1].isalpha() else 'x'}", f"letters{int(any(c.isalpha() for c in s))}", f"brackets{int('(' in s) + int(')' in s)}",
        f"left{left if left in '+-.@(/' else 's' if left.isspace() else 'x' if left.isalnum() else 'o'}",
        f"right{right if right in '-.@)/' else 's' if right.isspace() else 'x' if right.isalnum() else 'o'}",
        f"luhn{int(luhn(d)) if len(d) >= 13 else 2}",
    ]
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        named.append(f"octets{int(all(len(p) <= 3 and int(p) <= 255 for p in parts))}")
    name, _, host = s.partition("@")
    if host:
        named.append(f"host{int('.' in host.strip('. '))}{int(bool(name.strip()))}{int(host[-1].isalnum())}")
    named.append(f"shape{_shape(s)}")
    return [int.from_bytes(hashlib.blake2b(f.encode(), digest_size=4).digest(), "little") % SHAPES for f in named]


class Zone:
    """A zone's tokens and candidate segments with their features."""

    def __init__(self, text: str, a: int, b: int):
        self.cuts = [a, *(a + m.end() for m in _TOKEN.finditer(text[a:b]))]
        n = len(self.cuts) - 1
        self.n, self.segments, self.features = n, [], []
        useful = [text[x] in "+(" or text[x].isalnum() for x in self.cuts[:-1]]
        closing = [text[x - 1].isalnum() or text[x - 1] == ")" for x in self.cuts[1:]]
        for i in range(n):
            if not useful[i]:
                continue
            for j in range(i, min(n, i + MOST_TOKENS)):
                x, y = self.cuts[i], self.cuts[j + 1]
                if y - x > 120:
                    break
                if closing[j] and y - x >= 6 and _TRIGGER.search(text, x, y):
                    self.segments.append((i, j + 1))
                    self.features.append(segment_features(text, x, y))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Segments x kinds."""
        if not self.features:
            return np.empty((0, len(KINDS)))
        sizes = [len(f) for f in self.features]
        flat = weights[np.concatenate(self.features)]
        return np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)

    def posteriors(self, scores: np.ndarray) -> tuple[np.ndarray, float]:
        """Each segment's marginal for each kind, and the log partition sum; tokens outside score 0."""
        into: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (_, j) in enumerate(self.segments):
            into[j].append(k)
        flat = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.empty(0)
        fore = np.zeros(self.n + 1)
        for j in range(1, self.n + 1):
            fore[j] = np.logaddexp.reduce([fore[j - 1], *(fore[self.segments[k][0]] + flat[k] for k in into[j])])
        back = self._backward(flat)
        total = fore[self.n]
        first = np.array([i for i, _ in self.segments], int)
        last = np.array([j for _, j in self.segments], int)
        around = fore[first] + back[last] - total if len(first) else np.empty(0)
        return np.exp(scores + around[:, None]), total

    def _backward(self, flat: np.ndarray) -> np.ndarray:
        out_of: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (i, _) in enumerate(self.segments):
            out_of[i].append(k)
        back = np.zeros(self.n + 1)
        for i in range(self.n - 1, -1, -1):
            back[i] = np.logaddexp.reduce([back[i + 1], *(back[self.segments[k][1]] + flat[k] for k in out_of[i])])
        return back

    def decode(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """(segment, kind) of the best segmentation."""
        best, came = np.zeros(self.n + 1), [(-1, -1)] * (self.n + 1)
        into: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (_, j) in enumerate(self.segments):
            into[j].append(k)
        kind = scores.argmax(axis=1) if len(scores) else []
        for j in range(1, self.n + 1):
            best[j], came[j] = best[j - 1], (-1, -1)
            for k in into[j]:
                s = best[self.segments[k][0]] + scores[k, kind[k]]
                if s > best[j]:
                    best[j], came[j] = s, (k, int(kind[k]))
        out, j = [], self.n
        while j:
            k, t = came[j]
            if k >= 0:
                out.append((k, t))
                j = self.segments[k][0]
            else:
                j -= 1
        return out[::-1]


def rewritten(text: str, a: int, b: int, kind: int, n: int) -> tuple[str, int, int] | None:
    """A copy of the text whose entity is written in another way, and where it then lies."""
    s = text[a:b]
    if kind == 0:
        new = s.replace("@", " @ ") if n % 2 else s.replace("@", "@ ")
    elif kind == 2:
        d = _digits(s)
        new = (". /"[n % 3]).join(d[k : k + 4] for k in range(0, len(d), 4))
    elif kind == 3:
        new = s[1:] if n % 2 else re.sub(r"^\+[0-9]+[ .-]*", "", s)
        if len(_digits(new)) < 8:
            return None
    else:
        return None
    return text[:a] + new + text[b:], a, a + len(new)


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS) -> np.ndarray:
    """examples: a short text and its gold (kind, start, end). Weights: features x kinds."""
    weights = np.zeros((SHAPES, len(KINDS)))
    weights[:] = -0.3
    made = []
    for text, gold in examples:
        for a, b in zones(text):
            z = Zone(text, a, b)
            if not z.segments or z.n > 120:
                continue
            at = {(z.cuts[i], z.cuts[j]): k for k, (i, j) in enumerate(z.segments)}
            target = np.zeros((len(z.segments), len(KINDS)))
            for kind, x, y in gold:
                if (x, y) in at:
                    target[at[x, y], kind] = 1
            made.append((z, target, np.concatenate(z.features), np.repeat(np.arange(len(z.features)), [len(f) for f in z.features])))
    squares = np.full_like(weights, 1e-6)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for n in order.permutation(len(made)):
            z, target, flat, owner = made[n]
            marginal, _ = z.posteriors(z.scores(weights))
            step = (target - marginal)[owner]
            touched, inverse = np.unique(flat, return_inverse=True)
            g = np.zeros((len(touched), len(KINDS)))
            np.add.at(g, inverse, step)
            g -= 1e-4 * weights[touched]
            squares[touched] += g**2
            weights[touched] += 0.3 * g / np.sqrt(squares[touched])
    return weights


def fit_model(docs: DataFrame) -> np.ndarray:
    """Learns from the zones of a bounded sample of documents: the first SAMPLE_DOCS by a hash of the id."""
    ids = docs.where("doc_id is not null").select(docs["doc_id"].cast("long").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct().collect()
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in ids], "id long")
    texts = keyed_texts(docs).where("doc_id is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text")
    schema = "doc_id long, text string, kinds array<int>, starts array<int>, ends array<int>"

    def cut(batches):
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                spans = base_spans(text)
                for a, z in zones(text):
                    if z - a > 200:
                        continue
                    low, high = max(0, a - 12), min(len(text), z + 12)
                    own = [(k, x - low, y - low) for k, x, y in spans if x >= a and y <= z]
                    out.append((doc_id, text[low:high], *([o[n] for o in own] for n in range(3))))
            yield pd.DataFrame(out, columns=["doc_id", "text", "kinds", "starts", "ends"])

    per = texts.mapInPandas(cut, schema).dropDuplicates(["text"])
    rows = per.orderBy(F.size("kinds") == 0, F.xxhash64("text"), "text").limit(SAMPLE_ZONES // 2).union(
        per.where("size(kinds) = 0").orderBy(F.xxhash64("text"), "text").limit(SAMPLE_ZONES // 2)
    ).collect()
    examples = []
    for n, r in enumerate(rows):
        gold = list(zip(r["kinds"], r["starts"], r["ends"], strict=True))
        examples.append((r["text"], gold))
        if len(gold) == 1:
            new = rewritten(r["text"], gold[0][1], gold[0][2], gold[0][0], n)
            if new:
                examples.append((new[0], [(gold[0][0], new[1], new[2])]))
    return train(examples)


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    out = []
    for a, b in zones(text):
        z = Zone(text, a, b)
        if not z.segments:
            continue
        scores = z.scores(weights)
        best = z.decode(scores)
        if not best:
            continue
        marginal, _ = z.posteriors(scores)
        for k, kind in best:
            x, y = z.cuts[z.segments[k][0]], z.cuts[z.segments[k][1]]
            if marginal[k, kind] >= POSTERIOR and not any(p < y and x < q for _, p, q in base):
                out.append((kind, x, y))
    return out


def find_pii(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row per row of docs: doc_id, spans, base (arrays of struct<kind,start,end>, by kind as in KINDS, then start).

    Positions are code points, the end exclusive. Null text counts as empty and has no spans. Repeated rows give equal rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit_model(docs) if weights is None else weights)
    one = "array<struct<kind:string,start:int,end:int>>"

    def find(batches):
        for b in batches:
            rows = []
            for text in b["text"]:
                base = base_spans(text)
                every = sorted(base + added_spans(text, base, held.value))
                rows.append([[{"kind": KINDS[k], "start": x, "end": y} for k, x, y in s] for s in (every, base)])
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "spans": [r[0] for r in rows], "base": [r[1] for r in rows]})

    return keyed_texts(docs).mapInPandas(find, f"doc_id long, spans {one}, base {one}")


def pii_query(docs: DataFrame) -> DataFrame:
    """The digest of find_pii: n_* count base spans; n_added those that the model adds."""
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_pii(docs).select(
        "doc_id", *(number(k) for k in KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
