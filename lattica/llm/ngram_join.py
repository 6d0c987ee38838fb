"""Self-join of documents on the Jaccard similarity of their word n-gram sets, by a prefix tree.

1. Sets. Every whole text becomes its sorted set of 64-bit shingle hashes - one global order. Documents with equal sets form
   one class; only classes go on, so thousands of copies are one.
2. Candidates, exactly and in linear space. Two sets of sizes x <= y with Jaccard >= t differ in at most
   k = (1 - t) / (1 + t) * (x + y) elements. Sizes are cut into bands; in each band the hash space is cut into
   k + 1 + spare parts (spare is a SPARE-th of k), so at least spare + 1 parts of a similar pair are identical. A class sends
   one signature (the hash of a part's subset) for each part that is not empty - for the empty ones too if it has more than
   spare of them, which keeps the argument whole - in its own band, and in those below if a partner may lie there.
   Signatures met once go no further. Equal signatures are tied as a star to their least class, within each task before
   anything travels and again in each bucket after, so a signature that very many classes share is a row per task, never a
   pair per pair. Shingles that are frequent in the corpus (at most HEAVY_MOST, found by counting) would tie unlike texts
   that share a passage. The argument holds in any part of the hash space, so a set sends the signatures of what is left
   without them; where less than LIGHT_PART is left, on its own side or possibly on a partner's, those of the whole set go too.
3. Clusters are the components of those stars. No similar pair spans two clusters. Clusters above BLOCK_TOKENS are cut by the
   signatures of up to REFINE other salts, taken within the cluster: similar pairs stay together under every salt.
4. In each cluster a prefix tree holds the sets, their elements in one order (rare ones first); equal beginnings share a
   path and its overlap is counted once. A set is run down the paths whose sets share an element of the prefix with it; a
   subtree is left as soon as the shared part so far plus what can remain on both sides is too small, and a group of sets
   when it is already in the component at hand. What stays above BLOCK_TOKENS goes through large_edges().

Sets are named by 63-bit digests of their 64-bit shingle hashes.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import MASK63, Table, keyed_texts, mix64, slices_of, text_of, tidy
from .words import shingle_sets

SPARE = 10
BAND = 1.3
REFINE = 2
ASK_FIRST = 4
BUCKET_SIGNATURES = 500_000
FLUSH_SIGNATURES = 3_000_000
BLOCK_TOKENS = 1_000_000
LOCAL_COUNT = 3
HEAVY_COUNT = 30
HEAVY_MOST = 1 << 18
LIGHT_PART = 0.5
PROBE = 48
STANDS = 4
BROADCAST_ROWS = 500_000
EDGE = "a long, b long"


def set_digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) & MASK63


def class_rows(texts: DataFrame, width: int) -> DataFrame:
    """Rows of kind 0: doc_id, n_shingles, cid (null for empty sets). Rows of kind 1: a shingle often met in one place, its count."""

    def make(batches):
        for b in batches:
            sizes, cids, sets, held = [], [], [], 0
            doc_ids = b["doc_id"].astype("Int64")
            for s in shingle_sets(b["text"], width):
                sizes.append(len(s))
                cids.append(set_digest(s) if len(s) else None)
                sets.append(s)
                held += len(s)
                if held >= FLUSH_SIGNATURES:
                    yield often(sets)
                    sets, held = [], 0
            yield often(sets)
            yield pd.DataFrame({"kind": 0, "doc_id": doc_ids, "n_shingles": sizes, "cid": pd.array(cids, "Int64")})

    def often(sets):
        each, n = np.unique(np.concatenate(sets or [np.empty(0, np.uint64)]), return_counts=True)
        each, n = each[n >= LOCAL_COUNT], n[n >= LOCAL_COUNT]
        return pd.DataFrame({"kind": 1, "doc_id": pd.array(each.view(np.int64), "Int64"), "n_shingles": n, "cid": pd.array([None] * len(n), "Int64")})

    return texts.mapInPandas(make, "kind int, doc_id long, n_shingles long, cid long")


def heavy_shingles(rows: DataFrame) -> np.ndarray:
    """The most frequent shingles, at most HEAVY_MOST, sorted. Which they are changes what is compared, never what is found."""
    sums = rows.where("kind = 1").groupBy("doc_id").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= HEAVY_COUNT)
    top = sums.orderBy(F.desc("n"), "doc_id").limit(HEAVY_MOST).select("doc_id").toPandas()
    return np.sort(top["doc_id"].to_numpy(np.int64).view(np.uint64))


def bands_of(n: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(band, parts, spare) for a set of n elements; the similarity is num / den.

    A pair meets in the band of its smaller set, so a set also sends to every band below whose largest size it may join.
    """
    own = max(0, math.ceil(math.log(n, BAND)))
    while own and math.floor(BAND ** (own - 1) + 1e-9) >= n:
        own -= 1
    while math.floor(BAND**own + 1e-9) < n:
        own += 1
    out = []
    for band in range(own, -1, -1):
        top = math.floor(BAND**band + 1e-9)  # the largest size of the band; a partner from above is at most top * den / num
        if top * den < n * num:
            break
        if band and top == math.floor(BAND ** (band - 1) + 1e-9) and band != own:
            continue  # no size is in this band
        most = (den - num) * (top + top * den // num) // (den + num)
        spare = -(-most // SPARE)
        out.append((band, most + 1 + spare, spare))
    return out


def signatures(s: np.ndarray, heavy: np.ndarray, num: int, den: int, salt: int = 0) -> np.ndarray:
    """Of the set without heavy shingles if at least LIGHT_PART is left; of the whole set if that, or a partner's, may not be.

    Another salt cuts the hash space anew; similar pairs share a signature under every salt.
    """
    light = s[heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] != s] if len(heavy) else s
    rest = len(light) / len(s)
    ratio = den / num
    out = []
    if rest >= LIGHT_PART:
        out.append(_part_hashes(light, len(s), 2 * salt, num, den))
    if rest < LIGHT_PART * ratio + (den - num) / (den + num) * (1 + ratio):
        out.append(_part_hashes(s, len(s), 2 * salt + 1, num, den))
    return np.concatenate(out)


def _part_hashes(s: np.ndarray, size: int, kind: int, num: int, den: int) -> np.ndarray:
    out = []
    for band, parts, spare in bands_of(size, num, den):
        salt = (kind << 16) + band
        hashes = mix64(s ^ np.uint64(0xA5A5_0000_0000 + salt))
        part = (hashes % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        held, groups = part[order], mix64(hashes[order])
        starts = np.flatnonzero(np.diff(held, prepend=-1))
        which, sums = held[starts], np.add.reduceat(groups, starts) if len(s) else groups
        if parts - len(starts) > spare:
            none = np.setdiff1d(np.arange(parts), which)
            which, sums = np.concatenate([which, none]), np.concatenate([sums, np.zeros(len(none), np.uint64)])
        out.append(mix64(sums ^ mix64(which.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(salt))))
    return np.concatenate(out)


def _star(sigs: np.ndarray, cids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures once each with their least class, and the edges from that class to the others."""
    order = np.lexsort((cids, sigs))
    s, c = sigs[order], cids[order]
    head = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
    least = c[head][np.cumsum(head) - 1] if len(s) else c
    other = least != c
    edges = np.unique(np.stack([least[other], c[other]], 1), axis=0) if other.any() else np.empty((0, 2), np.int64)
    return s[head], c[head], edges


def candidate_edges(texts: DataFrame, total_shingles: int, heavy, width: int, num: int, den: int) -> DataFrame:
    buckets = slices_of(int(0.35 * total_shingles) + 1, BUCKET_SIGNATURES)

    def send(batches):
        sigs, cids, held = [], [], 0

        def flush():
            s, c, edges = _star(np.concatenate(sigs), np.concatenate(cids))
            bucket = (s >> np.uint64(16)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            s, c = s[order], c[order]
            rows = [(n, s[a:b].tobytes(), c[a:b].tobytes(), b"") for n, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            for n in range(0, len(edges), 200_000):
                rows.append((int(edges[n, 0]) % buckets, b"", b"", edges[n : n + 200_000].tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "sigs", "cids", "edges"])

        for b in batches:
            for s in shingle_sets(b["text"], width):
                if not len(s):
                    continue
                own = signatures(s, heavy.value, num, den)
                sigs.append(own)
                cids.append(np.full(len(own), set_digest(s), np.int64))
                held += len(own)
                if held >= FLUSH_SIGNATURES:
                    yield flush()
                    sigs, cids, held = [], [], 0
        if held:
            yield flush()

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        s = np.frombuffer(b"".join(rows["sigs"]), np.uint64)
        c = np.frombuffer(b"".join(rows["cids"]), np.int64)
        made = np.frombuffer(b"".join(rows["edges"]), np.int64).reshape(-1, 2)
        edges = np.unique(np.concatenate([made, _star(s, c)[2]]), axis=0)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    sent = texts.mapInPandas(send, "bucket int, sigs binary, cids binary, edges binary")
    return sent.groupBy("bucket").applyInPandas(meet, "a long, b long")


class Forest:
    """Union-find over positions, each component named by its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


class Node:
    __slots__ = ("run", "parent", "children", "ends", "least", "most", "asked", "marked")

    def __init__(self, run: np.ndarray, parent: Node | None):
        self.run, self.parent, self.children, self.ends = run, parent, {}, []
        self.least, self.most, self.asked, self.marked = 1 << 60, 0, -1, []


class PrefixTree:
    """Sorted sets with shared beginnings; each node holds a run of elements.

    The header names, for each element, the sets that have it in their prefix (the first size - ceil(t * size) + 1 elements,
    of which a similar pair shares one), grouped by component. A set enters the tree only along the paths that the header
    names for its own prefix, and leaves a group of the header as soon as it has joined that group's component.
    """

    def __init__(self, forest: Forest, num: int, den: int):
        self.root, self.forest, self.num, self.den = Node(np.empty(0, np.int64), None), forest, num, den
        self.header: dict[int, int | dict[int, list[int]]] = {}
        self.leaf: dict[int, Node] = {}
        self.size: dict[int, int] = {}
        self.question = 0

    def prefix(self, s: np.ndarray) -> list[int]:
        return s[: len(s) - -(-self.num * len(s) // self.den) + 1].tolist()

    def add(self, s: np.ndarray, member: int) -> None:
        node, at = self.root, 0
        self._count(node, len(s))
        while at < len(s):
            key = int(s[at])
            child = node.children.get(key)
            if child is None:
                child = node.children[key] = Node(s[at:], node)
                at = len(s)
            else:
                n = min(len(child.run), len(s) - at)
                differ = np.flatnonzero(child.run[:n] != s[at : at + n])
                shared = int(differ[0]) if len(differ) else n
                if shared < len(child.run):
                    upper = Node(child.run[:shared], node)
                    upper.least, upper.most = child.least, child.most
                    child.run, child.parent = child.run[shared:], upper
                    upper.children[int(child.run[0])] = child
                    node.children[key] = child = upper
                at += shared
            self._count(child, len(s))
            node = child
        node.ends.append(member)
        self.leaf[member], self.size[member] = node, len(s)
        for e in self.prefix(s):
            entry = self.header.get(e)
            if entry is None:
                self.header[e] = member
                continue
            if isinstance(entry, int):
                entry = self.header[e] = {entry: [entry]}
            entry.setdefault(self.forest.find(member), []).append(member)

    def _count(self, node: Node, size: int) -> None:
        node.least, node.most = min(node.least, size), max(node.most, size)

    def _groups(self, e: int) -> dict[int, list[int]]:
        """The header's sets for an element by the components of now."""
        entry = self.header.get(e)
        if entry is None:
            return {}
        find = self.forest.find
        if isinstance(entry, int):
            return {find(entry): [entry]}
        if any(find(r) != r for r in entry):
            merged: dict[int, list[int]] = {}
            for r, own in entry.items():
                have = merged.get(find(r))
                if have is None:
                    merged[find(r)] = own
                elif len(have) >= len(own):
                    have += own
                else:
                    own += have
                    merged[find(r)] = own
            entry = self.header[e] = merged
        return entry

    def link(self, s: np.ndarray, member: int) -> None:
        """Join member with one set of every component that has a similar one."""
        find, x, seen = self.forest.find, len(s), set()
        for e in self.prefix(s):
            for root, own in list(self._groups(e).items()):
                at, many = 0, 4
                while at < len(own) and find(root) != find(member):
                    batch = [m for m in own[at : at + many] if m not in seen and self.size[m] * self.num <= x * self.den and x * self.num <= self.size[m] * self.den]
                    if batch:
                        seen.update(batch)
                        self._descend(s, member, batch)
                    at, many = at + many, 2 * many

    def _descend(self, s: np.ndarray, member: int, targets: list[int]) -> None:
        """Run s down the paths to the targets, each shared part once."""
        self.question += 1
        self.root.asked, self.root.marked = self.question, []
        for m in targets:
            self._mark(self.leaf[m])
        x, num, den, forest = len(s), self.num, self.den, self.forest
        padded = np.append(s, np.int64(-1))
        wanted = set(targets)
        stack = [(self.root, 0, 0, 0)]  # node, overlap, elements of the path, elements of s that the path has passed
        while stack:
            node, overlap, depth, passed = stack.pop()
            # With y elements the pair needs den * overlap >= num * (x + y - overlap).
            y = max(node.least, -(-num * x // den))
            fits = y <= node.most and y * num <= x * den
            for a in range(0, len(node.run) if fits else 0, PROBE):
                run = node.run[a : a + PROBE]
                at = np.searchsorted(s, run)
                overlap += int((padded[at] == run).sum())
                depth += len(run)
                passed = int(at[-1])
                fits = (num + den) * (overlap + min(x - passed, node.most - depth)) >= num * (x + y)
                if not fits:
                    break
            if not fits:
                continue
            for other in node.ends:
                if other in wanted and (num + den) * overlap >= num * (x + self.size[other]):
                    forest.join(member, other)
            stack += [(c, overlap, depth, passed) for c in node.marked]

    def _mark(self, node: Node) -> None:
        """Hang the path from the root to the node into the marked tree."""
        below = None
        while True:
            new = node.asked != self.question
            if new:
                node.asked, node.marked = self.question, []
            if below is not None:
                node.marked.append(below)
            if not new:
                return
            below, node = node, node.parent


def ranked(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets over the numbers 0.. of one order: rare elements first, ties by hash. It is the same for all sets at hand."""
    if not sets:
        return []
    elements, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(elements), np.int64)
    rank[np.lexsort((elements, counts))] = np.arange(len(elements))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(part) for part in np.split(rank[inverse], cuts)]


def tree_components(sets: list[np.ndarray], num: int, den: int, roots: list[int] | None = None, asking: list[bool] | None = None) -> list[int]:
    """For each set the position of its component's first set. roots: components known before, by position.

    asking: only sets marked so are run against the tree of the others (and of one another).
    """
    forest = Forest(len(sets))
    if roots is not None:
        first: dict[int, int] = {}
        for n, r in enumerate(roots):
            forest.join(first.setdefault(r, n), n)
    tree, sets = PrefixTree(forest, num, den), ranked(sets)
    order = sorted(range(len(sets)), key=lambda n: len(sets[n]))
    if asking is not None:
        order = [n for n in order if not asking[n]] + [n for n in order if asking[n]]
    for n in order:
        if asking is None or asking[n]:
            tree.link(sets[n], n)
        tree.add(sets[n], n)
    return [forest.find(n) for n in range(len(sets))]


def _edges_of(frame: pd.DataFrame, num: int, den: int, roots=None, asking=None) -> pd.DataFrame:
    cids = frame["cid"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in frame["elements"]]
    found = tree_components(sets, num, den, roots, asking)
    return pd.DataFrame({"a": cids[found], "b": cids})


def refined(names: DataFrame, every: DataFrame, heavy, num: int, den: int, salt: int) -> DataFrame:
    """names: cluster, cid, n. The same under the clusters that another salt's signatures leave; sets left alone go."""

    def send(batches):
        for b in batches:
            own = [signatures(np.frombuffer(x, np.uint64), heavy.value, num, den, salt) for x in b["elements"]]
            size = [len(x) for x in own]
            place = mix64(np.repeat(b["cluster"].to_numpy(np.int64).view(np.uint64), size))
            yield pd.DataFrame({"sig": (np.concatenate(own) ^ place).view(np.int64), "cid": np.repeat(b["cid"].to_numpy(np.int64), size)})

    placed = names.select("cluster", "cid").join(every.select("cid", "elements"), "cid")
    sent = Table(placed.mapInPandas(send, "sig long, cid long"), "refined").read()
    least = sent.groupBy("sig").agg(F.min("cid").alias("a"), F.max("cid").alias("most")).where("a <> most").select("sig", "a")
    stars = sent.join(least, "sig").where("a <> cid").select("a", F.col("cid").alias("b")).distinct()
    found = connected_components(Table(stars, "refined-stars").read()).select(F.col("node").alias("cid"), F.col("root").alias("cluster"))
    return names.select("cid", "n").join(found, "cid").select("cluster", "cid", "n")


def verified_edges(sets: Table, heavy, num: int, den: int) -> DataFrame:
    """sets: cluster, cid, n, elements. Edges (a, b), self-edges among them, whose components are those of the true links.

    Elements are written once, in sets; what is written after holds only names.
    """
    every = sets.read()
    names, edges = every.select("cluster", "cid", "n"), None
    for salt in range(1, REFINE + 2):
        tokens = Table(names.groupBy("cluster").agg(F.sum("n").alias("tokens")), "tokens").read()
        small = tokens.where(F.col("tokens") <= BLOCK_TOKENS).select("cluster")
        ready = every if salt == 1 else names.select("cluster", "cid").join(every.drop("cluster"), "cid")
        found = Table(ready.join(small, "cluster").groupBy("cluster").applyInPandas(functools.partial(_alone, num, den), EDGE), "cluster-edges").read()
        edges = found if edges is None else edges.union(found)
        tidy(sets.spark)
        large = tokens.where(F.col("tokens") > BLOCK_TOKENS).select("cluster")
        if large.isEmpty():
            return edges
        names = names.join(large, "cluster").dropDuplicates(["cid"])
        if salt <= REFINE:
            names = Table(refined(names, every, heavy, num, den, salt), "names").read()
    return edges.union(large_edges(names, every, num, den))


def _alone(num: int, den: int, frame: pd.DataFrame) -> pd.DataFrame:
    return _edges_of(frame.drop_duplicates("cid").sort_values("cid", ignore_index=True), num, den)


def blocks_by_size(names: DataFrame) -> DataFrame:
    """names with a block: sets of like size together, about BLOCK_TOKENS elements in each. A size that alone has more is cut by hash."""
    per = names.groupBy("cluster", "n").agg((F.count("*") * F.col("n")).alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy("cluster").orderBy("n")) - F.col("tokens")  # one row for each size there is
    group = F.floor(before / BLOCK_TOKENS)
    cut = per.select("cluster", "n", F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)).alias("cuts"), group.alias("group"))
    own = F.when(F.col("cuts") > 1, F.struct(F.col("n").alias("x"), F.pmod(F.xxhash64("cid"), F.col("cuts")).alias("y")))
    own = F.coalesce(own, F.struct((-1 - F.col("group")).alias("x"), F.lit(0).cast("long").alias("y")))
    return names.join(cut, ["cluster", "n"]).withColumn("block", F.xxhash64("cluster", own)).drop("cuts", "group")


def large_edges(names: DataFrame, every: DataFrame, num: int, den: int) -> DataFrame:
    """Edges of the clusters that no salt makes small. names: cluster, cid, n.

    1. Blocks of sets of like size are joined alone. 2. STANDS sets stand for each larger component of a block; they are
    joined again, so that a component which the cut has parted is one. 3. Sets outside their cluster's largest component ask
    the blocks whose sizes they may link with: first ASK_FIRST of them, and those still outside all the others. A task holds
    one block and about BLOCK_TOKENS of askers.
    """
    named = Table(blocks_by_size(names), "blocks").read()
    elements = every.select("cid", "elements").dropDuplicates(["cid"])
    parts = named.select("cluster", "block", "cid").join(elements, "cid")
    edges = Table(parts.groupBy("block").applyInPandas(functools.partial(_alone, num, den), EDGE), "block-edges").read()

    def with_roots(edges: DataFrame) -> DataFrame:
        roots = connected_components(edges).select(F.col("node").alias("cid"), "root")
        return Table(named.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "rooted").read()

    rooted = with_roots(edges)
    mark = F.xxhash64("cid")
    picked = rooted.groupBy("cluster", "root", F.pmod(mark, F.lit(STANDS)).alias("s")).agg(F.min_by("cid", mark).alias("cid"), F.min_by("n", mark).alias("n"), F.count("*").alias("c"))
    many = picked.groupBy("root").agg(F.sum("c").alias("c")).where(F.col("c") >= STANDS).select("root")
    stands = Table(blocks_by_size(picked.join(many, "root").select("cluster", "cid", "n")), "stands").read()
    parts = stands.select("block", "cid").join(elements, "cid")
    edges = edges.union(Table(parts.groupBy("block").applyInPandas(functools.partial(_alone, num, den), EDGE), "stand-edges").read())
    ranges = Table(named.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")), "ranges").read()
    for first in (True, False):
        rooted = with_roots(edges)
        per = rooted.groupBy("cluster", "root").agg(F.count("*").alias("c"))
        main = per.groupBy("cluster").agg(F.max(F.struct("c", "root")).alias("m")).select("cluster", F.col("m.root").alias("main"))
        askers = rooted.join(main, "cluster").where("root <> main").select("cluster", "cid", "n", F.col("block").alias("home"), "root")
        fits = (F.col("low") * num <= F.col("n") * den) & (F.col("n") * num <= F.col("high") * den) & (F.col("block") != F.col("home"))
        visits = askers.join(ranges, "cluster").where(fits).select("cluster", "block", "cid", "n", "root")
        if first:
            near = Window.partitionBy("cid").orderBy(F.xxhash64("cid", "block"))
            visits = visits.withColumn("turn", F.row_number().over(near)).where(F.col("turn") <= ASK_FIRST).drop("turn")
        visits = Table(visits, "visits").read()
        load = visits.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("shifts"))
        asking = visits.join(load, "block").select("block", F.pmod(mark, F.col("shifts")).cast("int").alias("shift"), "cid", "root", F.lit(True).alias("asks"))
        there = rooted.join(load, "block").withColumn("shift", F.explode(F.sequence(F.lit(0), F.col("shifts") - 1)))
        there = there.select("block", "shift", "cid", "root", F.lit(False).alias("asks"))

        def ask(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["asks", "cid"], ignore_index=True)
            return _edges_of(frame, num, den, frame["root"].tolist(), frame["asks"].tolist())

        placed = there.union(asking).join(elements, "cid")
        edges = edges.union(Table(placed.groupBy("block", "shift").applyInPandas(ask, EDGE), "asked-edges").read())
        tidy(names.sparkSession)
    return edges


def ngram_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id. Documents link at Jaccard >= num / den.

    component_id is the least doc_id that links reach, the document's own included. Texts without words (null, empty) have
    no shingles and link with nothing. Repeated rows each get a row. A null doc_id keeps a null id and is never the least,
    but links like any other; its component_id is null only if its links reach no id. Empty input gives no rows. Columns
    other than doc_id and text are not read.
    """
    rows, roots, classes = _rows_and_roots(keyed_texts(docs), width, num, den)
    joined = rows.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = classes.join(roots, "cid", "left").groupBy(F.coalesce("root", "cid").alias("root")).agg(F.min("rep").alias("least"))
    out = joined.join(least, "root", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def _rows_and_roots(texts: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts: doc_id, text. (doc_id, n_shingles, cid) of every row; cid and root of the classes that link; cid, rep, n of all classes."""
    spark = texts.sparkSession
    scanned = Table(class_rows(texts, width), "classes")
    heavy = spark.sparkContext.broadcast(heavy_shingles(scanned.read()))
    rows = Table(scanned.read().where("kind = 0").drop("kind"), "rows")
    scanned.drop()
    total = rows.read().agg(F.sum("n_shingles")).first()[0] or 0
    classes = Table(rows.read().where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "class")
    stars = Table(candidate_edges(texts, total, heavy, width, num, den), "candidates")
    clusters = Table(connected_components(stars.read()), "clusters")
    tidy(spark)
    wanted = clusters.read().select(F.col("node").alias("cid"), F.col("root").alias("cluster"))
    wanted = Table(wanted.join(classes.read(), "cid").select("rep", "cid", "cluster"), "wanted").read()
    named = wanted.where("rep is not null")
    if named.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)  # 24 bytes a row; beyond that both sides are shuffled by id
    picked = texts.join(named, F.col("doc_id") == F.col("rep")).select("cid", "cluster", "text")

    def rebuild(batches):
        for b in batches:
            sets = list(shingle_sets(b["text"], width))
            right = [n for n, s in enumerate(sets) if len(s) and set_digest(s) == b["cid"].iloc[n]]
            yield pd.DataFrame({
                "cluster": b["cluster"].iloc[right], "cid": b["cid"].iloc[right],
                "n": [len(sets[n]) for n in right], "elements": [sets[n].tobytes() for n in right],
            })

    def name(batches):
        """Rows without an id are found by their set's digest; a task sends each digest once while its memory of them lasts."""
        seen: set[int] = set()
        for b in batches:
            own = {}
            for s in shingle_sets(b["text"], width):
                if len(s) and (c := set_digest(s)) not in seen:
                    seen.add(c)
                    own[c] = s
            if len(seen) > FLUSH_SIGNATURES:
                seen.clear()
            yield pd.DataFrame({"cid": list(own), "n": [len(s) for s in own.values()], "elements": [s.tobytes() for s in own.values()]})

    made = picked.mapInPandas(rebuild, "cluster long, cid long, n long, elements binary")
    nameless = wanted.where("rep is null").select("cid", "cluster")
    if not nameless.isEmpty():
        found = texts.where("doc_id is null").mapInPandas(name, "cid long, n long, elements binary").join(nameless, "cid")
        made = made.unionByName(found.dropDuplicates(["cid"]))
    sets = Table(made, "sets")
    tidy(spark)
    roots = Table(connected_components(verified_edges(sets, heavy, num, den)).withColumnRenamed("node", "cid"), "roots")
    sets.drop()
    return rows.read(), roots.read(), classes.read()


def keep_representatives(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs, all columns, of which one row of each component stays: that with the least doc_id.

    Of rows that share this doc_id, or of a component without ids, the one with the least text stays; of equal ones any.
    Texts without words (null, empty) are no component and all stay. An empty table stays empty; columns of any name are
    carried through.
    """
    tagged = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows, roots, classes = _rows_and_roots(tagged.select("doc_id", "text"), width, num, den)
    every = classes.join(roots, "cid", "left").groupBy(F.coalesce("root", "cid").alias("root"))
    winners = every.agg(F.min(F.struct(F.col("rep").isNull().alias("late"), "rep", "cid")).alias("w")).select("w.rep", "w.cid")
    winners = Table(winners, "winners").read()
    stay = winners.select(F.col("rep").alias("doc_id")).union(rows.where("cid is null").select("doc_id"))
    twice = Table(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice").read()
    one = tagged.where("doc_id is not null").join(stay.distinct(), "doc_id", "left_semi")
    unsure = tagged.where("doc_id is null")
    if not twice.isEmpty():
        one = one.join(twice, "doc_id", "left_anti")
        unsure = unsure.unionByName(tagged.join(twice, "doc_id", "left_semi").select("row", "doc_id", "text"))
    if unsure.isEmpty():
        return one.select("row.*")

    @F.pandas_udf("long")
    def digest(text: pd.Series) -> pd.Series:
        return pd.Series([set_digest(s) if len(s) else None for s in shingle_sets(text, width)], dtype="Int64")

    unsure = unsure.withColumn("cid", digest("text"))
    won = winners.select(F.col("rep").alias("id"), F.col("cid").alias("own"))
    first = unsure.join(won, (F.col("cid") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    first = first.groupBy("cid").agg(F.min_by("row", "text").alias("row"))
    return one.select("row.*").unionByName(unsure.where("cid is null").select("row.*")).unionByName(first.select("row.*"))
