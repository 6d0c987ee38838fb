"""Analytic level sets, conversions and topology measures."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..model import CUBE, FACES, IJK, NEAR26, box, inside, shifted


def _clamp(c: Column, band: float) -> Column:
    return F.least(F.greatest(c, F.lit(-band)), F.lit(band))


def lattice_dims(low, high, size: float) -> tuple[int, int, int]:
    return tuple(math.ceil((b - a) / size) + 1 for a, b in zip(low, high, strict=True))


def lattice_points(spark: SparkSession, low, high, size: float) -> DataFrame:
    """i, j, k, x, y, z: cell centres of the lattice from low to high; its origin lies half a cell before low."""
    cells = box(spark, lattice_dims(low, high, size))
    return cells.select(*IJK, *((F.lit(a - size / 2) + (F.col(c) + 0.5) * size).alias(x) for c, x, a in zip(IJK, "xyz", low, strict=True)))


def _grid(spark, low, high, size, band, sdf: Column) -> DataFrame:
    return lattice_points(spark, low, high, size).select(*IJK, _clamp(sdf, band).alias("v"))


def _p(center) -> list[Column]:
    return [F.col(c) - o for c, o in zip("xyz", center, strict=True)]


def _norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def sphere(spark, radius, center, size, band) -> DataFrame:
    pad = radius + band
    low, high = [c - pad for c in center], [c + pad for c in center]
    return _grid(spark, low, high, size, band, _norm(*_p(center)) - radius)


def box_set(spark, half, center, size, band) -> DataFrame:
    low, high = [c - h - band for c, h in zip(center, half, strict=True)], [c + h + band for c, h in zip(center, half, strict=True)]
    q = [F.abs(p) - h for p, h in zip(_p(center), half, strict=True)]
    outer = _norm(*(F.greatest(c, F.lit(0.0)) for c in q))
    return _grid(spark, low, high, size, band, outer + F.least(F.greatest(*q), F.lit(0.0)))


def torus(spark, major, minor, center, size, band) -> DataFrame:
    """Around the y axis."""
    wide, tall = major + minor + band, minor + band
    low, high = (center[0] - wide, center[1] - tall, center[2] - wide), (center[0] + wide, center[1] + tall, center[2] + wide)
    x, y, z = _p(center)
    return _grid(spark, low, high, size, band, _norm(_norm(x, z) - major, y) - minor)


def capsule(spark, a, b, radius, size, band) -> DataFrame:
    pad = radius + band
    low, high = [min(p, q) - pad for p, q in zip(a, b, strict=True)], [max(p, q) + pad for p, q in zip(a, b, strict=True)]
    d = [q - p for p, q in zip(a, b, strict=True)]
    pa = _p(a)
    along = sum((p * e for p, e in zip(pa[1:], d[1:], strict=True)), pa[0] * d[0]) / sum(e * e for e in d)
    h = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return _grid(spark, low, high, size, band, _norm(*(p - h * e for p, e in zip(pa, d, strict=True))) - radius)


def face_normals(faces: int) -> list[tuple[float, float, float]]:
    """Unit normals of the five regular solids, from their symmetries."""
    golden = (1 + math.sqrt(5)) / 2
    signs = list(product((-1, 1), repeat=3))
    turned = lambda a, b: [v for s, t in product((-1, 1), repeat=2) for v in ((0, s * a, t * b), (s * a, t * b, 0), (t * b, 0, s * a))]
    made = {
        4: [s for s in signs if s[0] * s[1] * s[2] > 0],
        6: list(FACES),
        8: signs,
        12: turned(1, golden),
        20: signs + turned(1 / golden, golden),
    }[faces]
    return [tuple(c / math.sqrt(sum(x * x for x in v)) for c in v) for v in made]


def platonic(spark, faces, radius, center, size, band) -> DataFrame:
    """The solid of `faces` faces whose inscribed sphere has this radius: the largest of its planes' distances."""
    reach = {4: 3.0, 6: math.sqrt(3), 8: math.sqrt(3), 12: 1.2584085723648188, 20: 1.2584085723648188}[faces] * radius + band
    low, high = [c - reach for c in center], [c + reach for c in center]
    x, y, z = _p(center)
    return _grid(spark, low, high, size, band, F.greatest(*(x * a + y * b + z * c - radius for a, b, c in face_normals(faces))))


def sdf_to_fog(voxels: DataFrame, cutoff: float) -> DataFrame:
    return voxels.withColumn("v", F.least(F.greatest(-F.col("v") / cutoff, F.lit(0.0)), F.lit(1.0)))


def interior_mask(voxels: DataFrame, iso: float = 0.0) -> DataFrame:
    return voxels.withColumn("v", (F.col("v") < iso).cast("int"))


def solid_euler(cells: DataFrame) -> DataFrame:
    """v, e, f, c and chi of the cubical complex of the cells. Each part is named by its doubled midpoint, so one
    explode and one distinct count all kinds."""
    parts = [(a, b, c) for a, b, c in CUBE]
    doubled = cells.select(*((F.col(c) * 2).alias(c) for c in IJK))
    every = shifted(doubled, parts).select(*IJK).distinct()
    odd = sum((F.col(c).bitwiseAND(F.lit(1)) for c in IJK[1:]), F.col("i").bitwiseAND(F.lit(1)))
    # A cell's midpoint is even along all axes; each odd axis lowers the dimension by one.
    counted = every.groupBy(odd.alias("odd")).agg(F.count("*").alias("n"))
    pick = lambda k, name: F.coalesce(F.sum(F.when(F.col("odd") == k, F.col("n"))), F.lit(0)).alias(name)
    out = counted.agg(pick(3, "v"), pick(2, "e"), pick(1, "f"), pick(0, "c"))
    return out.withColumn("chi", F.col("v") - F.col("e") + F.col("f") - F.col("c"))


def euler_characteristic(cells: DataFrame) -> DataFrame:
    """Of the surface: twice that of the solid."""
    return solid_euler(cells).select("v", "e", "f", "c", (2 * F.col("chi")).alias("euler"))


def segmentation(cells: DataFrame, connectivity: int = 6) -> DataFrame:
    """i, j, k, label: connected components, each labelled by its first cell in scan order (k, then j, then i).

    Every round each cell takes the least label around it and then its label's own label, so labels travel in jumps;
    a round is a scatter with a map-side minimum. It ends when nothing moves.
    """
    key = F.col("k").cast("long") + (1 << 20)
    key = F.shiftleft(F.shiftleft(key, 21) + F.col("j").cast("long") + (1 << 20), 21) + F.col("i").cast("long") + (1 << 20)
    offsets = ((0, 0, 0), *(FACES if connectivity == 6 else NEAR26))
    state = cut(cells.select(*IJK).distinct().withColumn("id", key).withColumn("label", F.col("id")))
    while True:
        around = shifted(state, offsets, "label").groupBy(*IJK).agg(F.min("label").alias("least"))
        near = state.join(around, list(IJK))
        # A root adopts the least label that any of its members met.
        roots = near.groupBy("label").agg(F.min("least").alias("root"))
        step = near.join(roots, "label").select(*IJK, "id", F.col("label").alias("old"), F.col("root").alias("label"))
        step = cut(step)
        moved = step.where("label <> old").limit(1).count()
        state = step.drop("old")
        if not moved:
            return state.select(*IJK, "label")


def first_cells(labels: DataFrame) -> DataFrame:
    """Labels as the coordinate of their first cell."""
    part = lambda shift: (F.shiftright("label", shift).bitwiseAND(F.lit((1 << 21) - 1)) - (1 << 20)).cast("int")
    return labels.select(*IJK, part(0).alias("label_i"), part(21).alias("label_j"), part(42).alias("label_k"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def enclosed_regions(dense: DataFrame, dims, iso: float = 0.0) -> DataFrame:
    """Outside cells (v >= iso) whose 6-connected region does not touch the border of the box."""
    labels = segmentation(dense.where(F.col("v") >= iso), 6)
    border = None
    for c, n in zip(IJK, dims, strict=True):
        edge = (F.col(c) == 0) | (F.col(c) == n - 1)
        border = edge if border is None else border | edge
    open_ = labels.where(border).select("label").distinct()
    return labels.join(open_, "label", "left_anti").select(*IJK)


def signed_flood_fill(dense: DataFrame, dims, band: float) -> DataFrame:
    """Cells with |v| >= band: +band where they reach the border through such cells, else -band; the others keep v."""
    far = dense.where(F.abs("v") >= band)
    labels = segmentation(far, 6)
    border = None
    for c, n in zip(IJK, dims, strict=True):
        edge = (F.col(c) == 0) | (F.col(c) == n - 1)
        border = edge if border is None else border | edge
    open_ = labels.where(border).select("label").distinct().withColumn("_open", F.lit(True))
    signed = labels.join(open_, "label", "left").select(*IJK, F.when(F.col("_open"), F.lit(band)).otherwise(F.lit(-band)).alias("_s"))
    return dense.join(signed, list(IJK), "left").select(*IJK, F.coalesce("_s", "v").alias("v"))


def genus(cells: DataFrame) -> DataFrame:
    """26-connected components less the solid's Euler characteristic."""
    parts = segmentation(cells, 26).agg(F.countDistinct("label").alias("components"))
    return parts.crossJoin(solid_euler(cells)).select("components", "chi", (F.col("components") - F.col("chi")).alias("genus"))  # one row each


def tile_dilation(cells: DataFrame, bits: int = 3) -> DataFrame:
    """Bricks within one of an active brick."""
    bricks = cells.select(*(F.shiftright(c, bits).alias(c) for c in IJK)).distinct()
    return shifted(bricks, CUBE).select(*IJK).distinct()


def fast_sweeping(dense: DataFrame, dims, band: float, size: float = 1.0) -> DataFrame:
    """Distances from the frozen band (|v| <= band) outwards, the sign kept: Godunov updates of all cells at once.

    Simultaneous updates have the same fixed point as ordered sweeps. Four rounds are one job; it ends when the last of four
    moved no cell by more than a billionth of a cell. Without a frozen cell all keep their input.
    """
    far = F.lit(1e30)
    state = dense.select(*IJK, F.col("v").alias("v0"), (F.abs("v") <= band).alias("frozen"), F.when(F.abs("v") <= band, F.abs("v")).otherwise(far).alias("d"))
    n = 0
    while True:
        # One scatter: each axis' lesser neighbour comes with its axis.
        sent = shifted(state, FACES, "d").where(inside(dims))
        axis = lambda a: F.min(F.when(F.col(a) != 0, F.col("d")))
        per = sent.groupBy(*IJK).agg(*(F.coalesce(axis(d), far).alias(f"m{c}") for c, d in zip(IJK, ("di", "dj", "dk"), strict=True)))
        s = F.sort_array(F.array("mi", "mj", "mk"))
        a, b, c = s[0], s[1], s[2]
        one = a + size
        two = 0.5 * (a + b + F.sqrt(F.greatest(2 * size * size - (a - b) ** 2, F.lit(0.0))))
        total = a + b + c
        disc = total * total - 3 * (a * a + b * b + c * c - size * size)
        three = F.when(disc < 0, two).otherwise((total + F.sqrt(F.greatest(disc, F.lit(0.0)))) / 3)
        made = F.when(one <= b, one).when(two <= c, two).otherwise(three)
        new = F.when(F.col("frozen") | (a >= far), F.col("d")).otherwise(F.least(F.col("d"), made))
        state = state.join(per, list(IJK)).select(*IJK, "v0", "frozen", new.alias("d"), (F.col("d") - new).alias("fell"))
        n += 1
        if n % 4 == 0:
            state = cut(state)
            if state.where(F.col("fell") > 1e-9 * size).isEmpty():
                break
    sign = F.when(F.col("v0") < 0, -1.0).otherwise(1.0)
    return state.select(*IJK, F.when(F.col("frozen") | (F.col("d") >= far), F.col("v0")).otherwise(sign * F.col("d")).alias("v"))
