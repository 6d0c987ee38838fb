"""Triangle and tetrahedral meshes: soup(fid, ax..cz) is one row per triangle with its three corners."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..checkpoint import cut
from ..model import IJK, inside, shifted


def soup_of(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vertices: vid, x, y, z; faces: fid, v0, v1, v2."""
    out = faces
    for corner, v in zip("abc", ("v0", "v1", "v2"), strict=True):
        named = vertices.select(F.col("vid").alias(v), *(F.col(x).alias(f"{corner}{x}") for x in "xyz"))
        out = out.join(named, v)
    return out.select("fid", *(f"{a}{x}" for a in "abc" for x in "xyz"))


def _sub(p: str, q: str) -> list[Column]:
    return [F.col(f"{p}{x}") - F.col(f"{q}{x}") for x in "xyz"]


def _dot(u, v) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _cross(u, v) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def triangle_areas(soup: DataFrame) -> DataFrame:
    n = _cross(_sub("b", "a"), _sub("c", "a"))
    return soup.select("fid", (F.sqrt(_dot(n, n)) / 2).alias("area"))


def mesh_summary(soup: DataFrame) -> DataFrame:
    """faces, area, and the signed volume that the triangles enclose."""
    a, b, c = ([F.col(f"{p}{x}") for x in "xyz"] for p in "abc")
    n = _cross(_sub("b", "a"), _sub("c", "a"))
    return soup.agg(
        F.count("*").alias("faces"), F.sum(F.sqrt(_dot(n, n)) / 2).alias("area"), (F.sum(_dot(a, _cross(b, c))) / 6).alias("volume")
    )


def edge_uses(faces: DataFrame) -> DataFrame:
    """Per undirected edge: how many faces use it, and how often in its own direction."""
    pairs = F.array(*(F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    rows = faces.select(F.explode(pairs).alias("e")).select("e.p", "e.q")
    return rows.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(
        F.count("*").alias("uses"), F.count(F.when(F.col("p") < F.col("q"), 1)).alias("ahead")
    )


def manifold_report(faces: DataFrame) -> DataFrame:
    """edges, open ones, those of more than two faces, and those whose two faces run the same way."""
    e = edge_uses(faces)
    return e.agg(
        F.count("*").alias("edges"), F.count(F.when(F.col("uses") == 1, 1)).alias("open"), F.count(F.when(F.col("uses") > 2, 1)).alias("crowded"),
        F.count(F.when((F.col("uses") == 2) & (F.col("ahead") != 1), 1)).alias("turned"),
    )


def point_triangle_distance2() -> Column:
    """Squared distance of (x, y, z) to the triangle of the row: the plane's foot if inside, else the nearest edge."""
    p = [F.col(x) for x in "xyz"]

    def edge(s: str, t: str) -> Column:
        d, w = _sub(t, s), [q - F.col(f"{s}{x}") for q, x in zip(p, "xyz", strict=True)]
        length = _dot(d, d)
        h = F.when(length > 0, F.least(F.greatest(_dot(w, d) / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        r = [a - h * b for a, b in zip(w, d, strict=True)]
        return _dot(r, r)

    n = _cross(_sub("b", "a"), _sub("c", "a"))
    size = _dot(n, n)
    w = [q - F.col(f"a{x}") for q, x in zip(p, "xyz", strict=True)]

    def side(s: str, t: str) -> Column:
        return _dot(_cross(_sub(t, s), [q - F.col(f"{s}{x}") for q, x in zip(p, "xyz", strict=True)]), n) >= 0

    inside_ = side("a", "b") & side("b", "c") & side("c", "a") & (size > 0)
    edges = F.least(edge("a", "b"), edge("b", "c"), edge("c", "a"))
    return F.when(inside_, _dot(w, n) * _dot(w, n) / size).otherwise(edges)


def point_triangle_distance(p: list, t: list) -> np.ndarray:
    """Distances of points to triangles, pair by pair: the plane's foot if inside, else the nearest edge. p: x, y, z; t: ax..cz."""
    a, b, c = t[:3], t[3:6], t[6:]
    sub = lambda u, v: [x - y for x, y in zip(u, v, strict=True)]

    def edge(s, t):
        d, w = sub(t, s), sub(p, s)
        length = _dot(d, d)
        h = np.where(length > 0, np.minimum(np.maximum(_dot(w, d) / np.where(length > 0, length, 1), 0), 1), 0)
        r = [x - h * y for x, y in zip(w, d, strict=True)]
        return _dot(r, r)

    n = _cross(sub(b, a), sub(c, a))
    size = _dot(n, n)
    side = lambda s, t: _dot(_cross(sub(t, s), sub(p, s)), n) >= 0
    inside_ = side(a, b) & side(b, c) & side(c, a) & (size > 0)
    above = _dot(sub(p, a), n)
    edges = np.minimum(np.minimum(edge(a, b), edge(b, c)), edge(c, a))
    return np.sqrt(np.where(inside_, above * above / np.where(size > 0, size, 1), edges))


LEAF = 16
SLICE = 20_000  # points, and triangles, that one call holds at most, but for chance
PAIRS = 100_000


def leaves(boxes: np.ndarray) -> np.ndarray:
    """Rows of at most LEAF places of boxes (n, 2, 3) near each other, filled up with repeats: halved along the longest side."""
    middle, order, ends = boxes.sum(axis=1), np.arange(len(boxes)), np.array([0, len(boxes)])
    while np.diff(ends).max() > LEAF:
        sizes = np.diff(ends)
        at = middle[order]
        wide = (np.maximum.reduceat(at, ends[:-1]) - np.minimum.reduceat(at, ends[:-1])).argmax(axis=1)
        part = np.repeat(np.arange(len(sizes)), sizes)
        order = order[np.lexsort((at[np.arange(len(at)), wide[part]], part))]
        ends = np.unique(np.concatenate([ends, ends[:-1] + sizes // 2]))
    return order[np.minimum(ends[:-1, None] + np.arange(np.diff(ends).max()), ends[1:, None] - 1)]


def _gap2(p: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Squared distances of points (..., 3) to boxes (..., 2, 3)."""
    out = 0
    for x in range(3):
        gap = np.maximum(np.maximum(boxes[..., 0, x] - p[..., x], p[..., x] - boxes[..., 1, x]), 0)
        out = out + gap * gap
    return out


def nearest_triangles(points: np.ndarray, soup: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the triangles (n, 9) to each point (m, 3), ties to the first, and its distance; -1 beyond the reach.

    The leaf whose box is nearest bounds a point's distance; only triangles whose boxes are within that bound are tried.
    """
    corners = soup.reshape(-1, 3, 3)
    boxes = np.stack([corners.min(axis=1), corners.max(axis=1)], axis=1)
    members = leaves(boxes)
    around = np.stack([boxes[members, 0].min(axis=1), boxes[members, 1].max(axis=1)], axis=1)
    slack = 1e-9 * (reach + (boxes[:, 1] - boxes[:, 0]).max())  # far above what rounding takes from a distance
    best, which = np.full(len(points), np.inf), np.full(len(points), len(soup))

    def measure(at, face):
        d = point_triangle_distance(list(points[at].T), list(soup[face].T))
        near = d <= reach
        at, face, d = at[near], face[near], d[near]
        had = best[at]
        np.minimum.at(best, at, d)
        which[at[best[at] < had]] = len(soup)
        first = d == best[at]
        np.minimum.at(which, at[first], face[first])

    step = max(1, min(512, 2_000_000 // len(members)))
    for a in range(0, len(points), step):
        here = np.arange(a, min(a + step, len(points)))
        gap = _gap2(points[here, None], around[None])
        own = members[gap.argmin(axis=1)]
        measure(np.repeat(here, own.shape[1]), own.ravel())
        bound = (np.minimum(best[here], reach) + slack) ** 2
        at, leaf = np.nonzero(gap <= bound[:, None])
        each = max(1, PAIRS // members.shape[1])
        for n in range(0, len(at), each):
            p, face = np.repeat(at[n : n + each], members.shape[1]), members[leaf[n : n + each]].ravel()
            kept = _gap2(points[here[p]], boxes[face]) <= bound[p]
            measure(here[p[kept]], face[kept])
    return np.where(np.isfinite(best), which, -1), best


def _columns(x) -> list:
    """A struct's columns, in its order."""
    return [c for child in x.flatten() for c in _columns(child)] if pa.types.is_struct(x.type) else [x]


def closest_triangle(points: DataFrame, key: str, soup: DataFrame, reach: float) -> DataFrame:
    """key, fid, distance: the nearest triangle within reach (ties to the lower fid). Rows that lack a coordinate are left out.

    Triangles are sent to the buckets, two reaches wide, that their box grown by the reach touches; a point is in one bucket
    and finds its nearest there by a tree of boxes. A bucket of more than SLICE points or triangles is cut into slices, each
    of which meets each of the other side's.
    """
    bucket = lambda c: F.floor(c / (2 * reach)).cast("int")
    corners, place = [f"{p}{x}" for p in "abc" for x in "xyz"], ["gx", "gy", "gz"]
    sent = soup.select("fid", *(F.col(c).cast("double").alias(c) for c in corners)).dropna(subset=corners)
    for x in "xyz":
        own = [F.col(f"{p}{x}") for p in "abc"]
        span = F.sequence(bucket(F.least(*own) - reach), bucket(F.greatest(*own) + reach))
        sent = sent.withColumn(f"g{x}", F.explode(span))
    placed = points.select(F.col(key).alias("key"), *(F.col(x).cast("double").alias(x) for x in "xyz")).dropna(subset=["x", "y", "z"])
    placed = placed.select("*", *(bucket(F.col(x)).alias(f"g{x}") for x in "xyz"))
    slices = lambda rows, name: rows.groupBy(*place).agg(F.ceil(F.count("*") / SLICE).alias(name))
    sizes = slices(placed, "np").join(slices(sent, "nt"), place)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = placed.join(sizes, place).select("*", F.pmod(F.xxhash64("key", "x", "y", "z"), "np").alias("sp"), every("nt").alias("st"))
    right = sent.join(sizes, place).select("*", F.pmod(F.xxhash64("fid"), "nt").alias("st"), every("np").alias("sp"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            parts = _columns(right["fid"].combine_chunks())
            named = pa.table(parts, names=[str(n) for n in range(len(parts))])
            right = right.take(pc.sort_indices(named, sort_keys=[(n, "ascending") for n in named.column_names], null_placement="at_start"))
            at, d = nearest_triangles(*(np.stack([t[c].to_numpy() for c in names], 1) for t, names in ((left, list("xyz")), (right, corners))), reach)
            met = np.flatnonzero(at >= 0)
            columns = [left["key"].take(pa.array(met)), right["fid"].take(pa.array(at[met])), pa.array(d[met])]
        else:
            columns = [left["key"].slice(0, 0), right["fid"].slice(0, 0), pa.array([], "double")]
        return pa.table(columns, names=["key", "fid", "d"])

    schema = StructType([placed.schema["key"], sent.schema["fid"], StructField("d", DoubleType())])
    cell = [*place, "sp", "st"]
    met = left.select("key", "x", "y", "z", *cell).groupBy(*cell).cogroup(right.select("fid", *corners, *cell).groupBy(*cell)).applyInArrow(meet, schema)
    best = met.groupBy("key").agg(F.min(F.struct("d", "fid")).alias("m"))
    return best.select(F.col("key").alias(key), F.col("m.fid").alias("fid"), F.col("m.d").alias("distance"))


def winding(points: DataFrame, key: str, soup: DataFrame) -> DataFrame:
    """The exact winding number: solid angles of all triangles over 4 pi. A small mesh only: it is sent to every task."""
    if soup.limit(100_001).count() > 100_000:
        raise ValueError("more than 100,000 triangles; cut the mesh and add up the parts")
    near = {p: [F.col(f"{p}{x}") - F.col(x) for x in "xyz"] for p in "abc"}
    size = {p: F.sqrt(_dot(v, v)) for p, v in near.items()}
    det = _dot(near["a"], _cross(near["b"], near["c"]))
    low = (
        size["a"] * size["b"] * size["c"] + _dot(near["a"], near["b"]) * size["c"]
        + _dot(near["b"], near["c"]) * size["a"] + _dot(near["c"], near["a"]) * size["b"]
    )
    angle = 2 * F.atan2(det, low)
    every = points.select(key, "x", "y", "z").join(F.broadcast(soup), F.lit(True))
    return every.groupBy(key).agg((F.sum(angle) / (4 * math.pi)).alias("winding"))


def mesh_to_sdf(cells: DataFrame, soup: DataFrame, band: float, size: float = 1.0) -> DataFrame:
    """Clamped distance of cell centres to the mesh, negative where the winding number is at least a half."""
    centres = cells.select(F.struct(*IJK).alias("cell"), *(((F.col(c) + 0.5) * size).alias(x) for c, x in zip(IJK, "xyz", strict=True)))
    near = closest_triangle(centres, "cell", soup, band)
    sign = winding(centres, "cell", soup).select("cell", F.when(F.col("winding") >= 0.5, -1.0).otherwise(1.0).alias("s"))
    out = sign.join(near, "cell", "left")
    return out.select(*(F.col(f"cell.{c}").alias(c) for c in IJK), (F.col("s") * F.coalesce("distance", F.lit(band))).alias("v"))


def marching_cases(dense: DataFrame, dims, iso: float = 0.0) -> DataFrame:
    """i, j, k, case: for each cube of eight cell centres its inside bits, corner x + 2y + 4z."""
    corners = [(-a, -b, -c) for c, b, a in product((0, 1), repeat=3)]
    bit = F.shiftleft((F.col("v") < iso).cast("int"), 0)
    place = (-F.col("di")) + (-F.col("dj")) * 2 + (-F.col("dk")) * 4
    small = tuple(n - 1 for n in dims)
    rows = shifted(dense, corners, "v").where(inside(small))
    return rows.groupBy(*IJK).agg(F.sum(bit * F.pow(F.lit(2.0), place).cast("int")).cast("int").alias("case"))


def surface_cubes(dense: DataFrame, dims, iso: float = 0.0) -> DataFrame:
    """Cubes that the surface passes, by case."""
    return marching_cases(dense, dims, iso).where("case between 1 and 254").groupBy("case").agg(F.count("*").alias("n"))


def crossing_vertices(dense: DataFrame, dims, iso: float = 0.0) -> DataFrame:
    """The mesh's vertices: one on each lattice edge whose ends differ, interpolated. axis 0, 1, 2 and the edge's lower cell."""
    sent = shifted(dense, ((0, 0, 0), (-1, 0, 0), (0, -1, 0), (0, 0, -1)), "v").where(inside(dims))
    pick = lambda c: F.max(F.when(F.col(c) == -1, F.col("v")))
    own = F.max(F.when((F.col("di") == 0) & (F.col("dj") == 0) & (F.col("dk") == 0), F.col("v")))
    per = sent.groupBy(*IJK).agg(own.alias("v"), pick("di").alias("n0"), pick("dj").alias("n1"), pick("dk").alias("n2"))
    rows = per.select(*IJK, "v", F.posexplode(F.array("n0", "n1", "n2")).alias("axis", "next")).where("next is not null")
    rows = rows.where((F.col("v") < iso) != (F.col("next") < iso))
    part = (F.lit(iso) - F.col("v")) / (F.col("next") - F.col("v"))
    return rows.select(*IJK, "axis", *((F.col(c) + 0.5 + F.when(F.col("axis") == n, part).otherwise(0.0)).alias(x) for n, (c, x) in enumerate(zip(IJK, "xyz", strict=True))))


# The six tetrahedra around a cube's diagonal from corner 0 to corner 7.
KUHN = ((0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7))


def cells_near(soup: DataFrame, reach: float, size: float, shift: float) -> DataFrame:
    """i, j, k, x, y, z: cells whose centre (i + shift) * size may be within reach of a triangle.

    Each triangle names the cells of its own box grown by the reach; those farther than the reach from its plane go at once,
    so that a large slanting triangle sends about its area in cells and not its box. One distinct count follows.
    """
    n = _cross(_sub("b", "a"), _sub("c", "a"))
    rows = soup.select(*(f"{p}{x}" for p in "abc" for x in "xyz"), *(v.alias(f"n{x}") for v, x in zip(n, "xyz", strict=True)), F.sqrt(_dot(n, n)).alias("nn"))
    for c, x in zip(IJK, "xyz", strict=True):
        corners = [F.col(f"{p}{x}") for p in "abc"]
        low = F.ceil((F.least(*corners) - reach) / size - shift).cast("int")
        high = F.floor((F.greatest(*corners) + reach) / size - shift).cast("int")
        rows = rows.withColumn(c, F.explode(F.when(low <= high, F.sequence(low, high))))
    off = sum((((F.col(c) + shift) * size - F.col(f"a{x}")) * F.col(f"n{x}") for c, x in zip(IJK[1:], "yz", strict=True)), ((F.col("i") + shift) * size - F.col("ax")) * F.col("nx"))
    near = rows.where(F.abs(off) <= reach * F.col("nn") * (1 + 1e-9)).select(*IJK).distinct()
    return near.select(*IJK, *(((F.col(c) + shift) * size).alias(x) for c, x in zip(IJK, "xyz", strict=True)))


def mesh_to_level_set(soup: DataFrame, size: float, outside: float, inside: float) -> DataFrame:
    """i, j, k, v with -inside < v < outside: the narrow band around a mesh, without its box. Cell i has its centre at i * size.

    Distances are exact; a cell is inside where the winding number is beyond a half either way, so open and inside-out meshes
    get a sign too. Cells that are not there are outside or inside by the flood of their neighbours' signs. An empty mesh
    gives no cells.
    """
    reach = max(outside, inside)
    cells = cells_near(soup, reach, size, 0.0).select(F.struct(*IJK).alias("cell"), "x", "y", "z")
    near = closest_triangle(cells, "cell", soup, reach)
    held = near.join(winding(cells, "cell", soup), "cell")
    v = F.when(F.abs("winding") > 0.5, -F.col("distance")).otherwise(F.col("distance"))
    return held.select("cell.*", v.alias("v")).where((F.col("v") > -inside) & (F.col("v") < outside))


def level_set_rebuild(voxels: DataFrame, outside: float, inside: float, iso: float = 0.0, size: float = 1.0) -> DataFrame:
    """i, j, k, v with -inside < v < outside: true distances to the surface v = iso of a field that need not hold distances.

    voxels may be sparse; the surface is that of the cubes whose eight corners are there. Cells it reaches keep the side they
    had. A cell that was not there takes the side that its nearest triangle faces: triangles face the side at or above iso.
    """
    found = surface_triangles(voxels, None, iso)
    corners = [f"{p}{x}" for p in "abc" for x in "xyz"]
    soup = found.select(F.struct(*IJK, "tet", "n").alias("fid"), *((F.col(c) * size).alias(c) for c in corners))
    soup = cut(soup)  # read three times
    reach = max(outside, inside)
    cells = cells_near(soup, reach, size, 0.5).select(F.struct(*IJK).alias("cell"), "x", "y", "z")
    near = closest_triangle(cells, "cell", soup, reach).join(soup, "fid").join(cells, "cell")
    ahead = _dot(_cross(_sub("b", "a"), _sub("c", "a")), [F.col(x) - F.col(f"a{x}") for x in "xyz"])
    placed = near.select("cell.*", "distance", F.when(ahead < 0, -1.0).otherwise(1.0).alias("facing"))
    had = voxels.select(*IJK, F.when(F.col("v") < iso, -1.0).otherwise(1.0).alias("had"))
    v = F.coalesce("had", "facing") * F.col("distance")
    return placed.join(had, list(IJK), "left").select(*IJK, v.alias("v")).where((F.col("v") > -inside) & (F.col("v") < outside))


def level_set_track(voxels: DataFrame, outside: float, inside: float, size: float = 1.0) -> DataFrame:
    """The band after its values were edited: rebuilt around the surface v = 0, grown and cut to the widths."""
    return level_set_rebuild(voxels, outside, inside, 0.0, size)


def surface_triangles(dense: DataFrame, dims=None, iso: float = 0.0) -> DataFrame:
    """A triangle soup of the isosurface (i, j, k, tet, n, ax..cz), facing the side at or above iso.

    Cubes whose eight corners are there count; dims, if given, only saves the others of a full box from being tried.
    Each cube is cut into six tetrahedra that share its diagonal, so neighbouring cubes agree on their faces and no case is
    ambiguous; a tetrahedron gives one triangle, or two where two corners are inside.
    """
    corners = [(-a, -b, -c) for c, b, a in product((0, 1), repeat=3)]
    place = (-F.col("di")) + (-F.col("dj")) * 2 + (-F.col("dk")) * 4
    sent = shifted(dense, corners, "v")
    sent = sent if dims is None else sent.where(inside(tuple(n - 1 for n in dims)))
    per = sent.groupBy(*IJK).agg(F.count("v").alias("there"), *(F.max(F.when(place == n, F.col("v"))).alias(f"c{n}") for n in range(8)))
    low, high = F.least(*(f"c{n}" for n in range(8))), F.greatest(*(f"c{n}" for n in range(8)))
    per = per.where((F.col("there") == 8) & (low < iso) & (high >= iso))
    tets = F.array(*(F.array(*(F.struct(F.col(f"c{c}").alias("v"), *((F.col(a) + (0.5 + (c >> n & 1))).alias(x) for n, (a, x) in enumerate(zip(IJK, "xyz", strict=True)))) for c in tet)) for tet in KUHN))
    rows = per.select(*IJK, F.posexplode(tets).alias("tet", "t"))
    ins, outs = F.filter("t", lambda p: p["v"] < iso), F.filter("t", lambda p: p["v"] >= iso)
    rows = rows.withColumn("ins", ins).withColumn("outs", outs).where((F.size("ins") > 0) & (F.size("outs") > 0))

    def crossing(p, q) -> Column:
        h = (F.lit(iso) - p["v"]) / (q["v"] - p["v"])
        return F.struct(*((p[x] + h * (q[x] - p[x])).alias(x) for x in "xyz"))

    i, o = (lambda n: F.get("ins", F.lit(n))), (lambda n: F.get("outs", F.lit(n)))
    one = F.array(F.array(crossing(i(0), o(0)), crossing(i(0), o(1)), crossing(i(0), o(2))))
    three = F.array(F.array(crossing(i(0), o(0)), crossing(i(1), o(0)), crossing(i(2), o(0))))
    two = F.array(F.array(crossing(i(0), o(0)), crossing(i(0), o(1)), crossing(i(1), o(1))), F.array(crossing(i(0), o(0)), crossing(i(1), o(1)), crossing(i(1), o(0))))
    made = rows.withColumn("s", F.when(F.size("ins") == 1, one).when(F.size("ins") == 2, two).otherwise(three))
    made = made.select(*IJK, "tet", F.get("ins", F.lit(0)).alias("seen"), F.posexplode("s").alias("n", "p"))
    flat = made.select(*IJK, "tet", "n", "seen", *(F.col("p")[n][x].alias(f"{a}{x}") for n, a in enumerate("abc") for x in "xyz"))
    normal = _cross(_sub("b", "a"), _sub("c", "a"))
    away = _dot(normal, [F.col(f"a{x}") - F.col(f"seen.{x}") for x in "xyz"]) >= 0
    turned = [F.when(away, F.col(f"{p}{x}")).otherwise(F.col(f"{q}{x}")).alias(f"{p}{x}") for p, q in (("b", "c"), ("c", "b")) for x in "xyz"]
    return flat.select(*IJK, "tet", "n", "ax", "ay", "az", *turned)


def interior_tets(dense: DataFrame, dims, iso: float = 0.0) -> DataFrame:
    """i, j, k, tet: tetrahedra of the lattice that lie inside with all four corners."""
    cases = marching_cases(dense, dims, iso)
    masks = F.array(*(F.lit(sum(1 << c for c in tet)) for tet in KUHN))
    rows = cases.select(*IJK, "case", F.posexplode(masks).alias("tet", "mask"))
    return rows.where(F.col("case").bitwiseAND(F.col("mask")) == F.col("mask")).select(*IJK, "tet")


def tet_quality(tets: DataFrame) -> DataFrame:
    """tets: tid, ax..dz. Per tetrahedron: signed volume, least and largest dihedral angle in degrees."""
    ab, ac, ad = _sub("b", "a"), _sub("c", "a"), _sub("d", "a")
    volume = _dot(ab, _cross(ac, ad)) / 6
    normals = {}
    for left_out, (p, q, r) in {"d": "abc", "c": "adb", "b": "acd", "a": "bdc"}.items():
        normals[left_out] = _cross(_sub(q, p), _sub(r, p))
    angles = []
    for s, t in (("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")):
        n, m = normals[s], normals[t]
        c = _dot(n, m) / F.sqrt(_dot(n, n) * _dot(m, m))
        angles.append(180 - F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))))
    return tets.select("tid", volume.alias("volume"), F.least(*angles).alias("least"), F.greatest(*angles).alias("largest"))


def tet_mesh_quality(tets: DataFrame) -> DataFrame:
    q = tet_quality(tets)
    return q.agg(
        F.min("least").alias("least"), F.max("largest").alias("largest"), F.sum("volume").alias("volume"),
        F.count(F.when(F.col("volume") <= 0, 1)).alias("inverted"), F.count("*").alias("tets"),
    )
