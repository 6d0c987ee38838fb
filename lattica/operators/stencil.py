"""Morphology, filters, differential operators and sparse convolution.

On a full box an axis pass is a window over that axis' lines: one shuffle, no join, and neighbours come from lag and lead.
Where many neighbours in several axes meet (morphology, sparse grids, medians), values are scattered to their targets and
aggregated: one shuffle with a map-side part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CUBE, FACES, IJK, inside, shifted


def _line(axis: str) -> Window:
    return Window.partitionBy(*(c for c in IJK if c != axis)).orderBy(axis)


def tap(axis: str, step: int, value: str = "v") -> Column:
    """The value `step` cells on along the axis, the border value beyond the box."""
    line = _line(axis)
    if step == 0:
        return F.col(value)
    ends = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if step < 0:
        return F.coalesce(F.lag(value, -step).over(line), F.first(value).over(ends))
    return F.coalesce(F.lead(value, step).over(line), F.last(value).over(ends))


def near(axis: str, step: int, value: str = "v") -> Column:
    """The neighbour one cell away, or the cell itself at the border."""
    move = F.lag if step < 0 else F.lead
    return F.coalesce(move(value, 1).over(_line(axis)), F.col(value))


def _sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def morph(dense: DataFrame, dims, op: str, times: int = 1) -> DataFrame:
    """dilate takes the least of the seven, erode the largest; outside the box counts as the cell itself."""
    pick = {"dilate": F.min, "erode": F.max}[op]
    out = dense
    for _ in range(times):
        out = shifted(out, ((0, 0, 0), *FACES), "v").where(inside(dims)).groupBy(*IJK).agg(pick("v").alias("v"))
    return out


def opened(dense: DataFrame, dims, times: int = 1) -> DataFrame:
    return morph(morph(dense, dims, "erode", times), dims, "dilate", times)


def closed(dense: DataFrame, dims, times: int = 1) -> DataFrame:
    return morph(morph(dense, dims, "dilate", times), dims, "erode", times)


def separable(dense: DataFrame, weights: list[float]) -> DataFrame:
    """One weighted pass along each axis in turn, taps clamped to the box."""
    radius, out = len(weights) // 2, dense
    for axis in IJK:
        out = out.withColumn("v", _sum([tap(axis, n - radius) * F.lit(w) for n, w in enumerate(weights)]))
    return out


def mean_filter(dense: DataFrame, width: int = 1) -> DataFrame:
    n = 2 * width + 1
    return separable(dense, [1 / n] * n)


def gaussian_weights(width: int, sigma: float) -> list[float]:
    raw = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-width, width + 1)]
    return [w / sum(raw) for w in raw]


def gaussian_filter(dense: DataFrame, width: int = 1) -> DataFrame:
    """Radius `width`, sigma half of it."""
    return separable(dense, gaussian_weights(width, 0.5 * width))


def _six(dense: DataFrame) -> Column:
    return _sum([near(axis, step) for axis in IJK for step in (-1, 1)])


def laplacian_filter(dense: DataFrame, times: int = 1) -> DataFrame:
    out = dense
    for _ in range(times):
        out = out.withColumn("_n", _six(out)).withColumn("v", F.col("v") + (F.col("_n") - 6 * F.col("v")) / 8).drop("_n")
    return out


def laplacian(dense: DataFrame, size: float = 1.0) -> DataFrame:
    return dense.select(*IJK, ((_six(dense) - 6 * F.col("v")) / (size * size)).alias("v"))


def median_filter(dense: DataFrame, dims, radius: int = 1) -> DataFrame:
    """The middle of the (2r+1)^3 values around each cell, border values repeated."""
    span = range(-radius, radius + 1)
    offsets = [(a, b, c) for a in span for b in span for c in span]
    # A clamped tap of a target is a source; from the source, its targets are all cells whose clamped tap it is.
    rows = dense.select(*IJK)
    taps = shifted(rows, offsets)
    target = [(F.col(c) - F.col(d)).alias(f"t{c}") for c, d in zip(IJK, ("di", "dj", "dk"), strict=True)]
    source = [F.least(F.greatest(F.col(c), F.lit(0)), F.lit(n - 1)).alias(c) for c, n in zip(IJK, dims, strict=True)]
    got = taps.select(*target, *source).join(dense.select(*IJK, "v"), list(IJK))
    per = got.groupBy("ti", "tj", "tk").agg(F.sort_array(F.collect_list("v")).alias("s"))  # (2r+1)^3 values
    return per.select(F.col("ti").alias("i"), F.col("tj").alias("j"), F.col("tk").alias("k"), F.col("s")[len(offsets) // 2].alias("v"))


def difference(axis: str, n: int, size: float = 1.0, value: str = "v") -> Column:
    """Central inside, one-sided at the borders, 0 along an axis of one cell."""
    if n == 1:
        return F.lit(0.0)
    line = _line(axis)
    before, after, here = F.lag(value).over(line), F.lead(value).over(line), F.col(value)
    return F.when(before.isNull(), (after - here) / size).when(after.isNull(), (here - before) / size).otherwise((after - before) / (2 * size))


def gradient(dense: DataFrame, dims, size: float = 1.0) -> DataFrame:
    return dense.select(*IJK, "v", *(difference(c, n, size).alias(f"g{x}") for c, n, x in zip(IJK, dims, "xyz", strict=True)))


def divergence(vectors: DataFrame, dims, size: float = 1.0) -> DataFrame:
    """vectors: x, y, z."""
    return vectors.select(*IJK, _sum([difference(c, n, size, x) for c, n, x in zip(IJK, dims, "xyz", strict=True)]).alias("v"))


def curl(vectors: DataFrame, dims, size: float = 1.0) -> DataFrame:
    d = lambda axis, value: difference(axis, dims[IJK.index(axis)], size, value)
    return vectors.select(
        *IJK, (d("j", "z") - d("k", "y")).alias("x"), (d("k", "x") - d("i", "z")).alias("y"), (d("i", "y") - d("j", "x")).alias("z")
    )


def magnitude(vectors: DataFrame) -> DataFrame:
    return vectors.select(*IJK, F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("v"))


def normalize(vectors: DataFrame) -> DataFrame:
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return vectors.select(*IJK, *(F.when(size > 0, F.col(c) / size).otherwise(0.0).alias(c) for c in "xyz"))


def closest_points(dense: DataFrame, dims, size: float = 1.0) -> DataFrame:
    """p - v * gradient at each cell's centre, in the grid's own frame."""
    g = gradient(dense, dims, size)
    return g.select(*IJK, *((((F.col(c) + 0.5) * size) - F.col("v") * F.col(f"g{x}")).alias(x) for c, x in zip(IJK, "xyz", strict=True)))


def mean_curvature_flow(dense: DataFrame, dims, step: float, times: int = 1, size: float = 1.0) -> DataFrame:
    """v + step * |grad| * curvature; border voxels never change. One scatter of the 19 neighbours a step."""
    if min(dims) < 3:
        raise ValueError("needs three cells along each axis")
    out = dense
    used = [o for o in CUBE if sum(map(abs, o)) <= 2]
    for _ in range(times):
        # A value scattered to offset o is, for its target, the neighbour at -o.
        rows = shifted(out, used, "v").where(inside(dims))
        name = lambda o: "n" + "".join("mzp"[x + 1] for x in o)
        at = lambda o: (F.col("di") == -o[0]) & (F.col("dj") == -o[1]) & (F.col("dk") == -o[2])
        per = rows.groupBy(*IJK).agg(*(F.max(F.when(at(o), F.col("v"))).alias(name(o)) for o in used))
        unit = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
        n = lambda o: F.col(name(tuple(o)))
        neg = lambda o: tuple(-x for x in o)
        add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
        d = [(n(u) - n(neg(u))) / (2 * size) for u in unit]
        dd = [(n(u) - 2 * n((0, 0, 0)) + n(neg(u))) / (size * size) for u in unit]
        cross = lambda a, b: (n(add(a, b)) - n(add(a, neg(b))) - n(add(neg(a), b)) + n(add(neg(a), neg(b)))) / (4 * size * size)
        dxy, dxz, dyz = cross(unit[0], unit[1]), cross(unit[0], unit[2]), cross(unit[1], unit[2])
        square = d[0] ** 2 + d[1] ** 2 + d[2] ** 2
        top = (
            d[0] ** 2 * (dd[1] + dd[2]) + d[1] ** 2 * (dd[0] + dd[2]) + d[2] ** 2 * (dd[0] + dd[1])
            - 2 * (d[0] * d[1] * dxy + d[0] * d[2] * dxz + d[1] * d[2] * dyz)
        )
        moved = n((0, 0, 0)) + F.when(square > 1e-12, step * top / square).otherwise(0.0)
        border = _sum([((F.col(c) == 0) | (F.col(c) == m - 1)).cast("int") for c, m in zip(IJK, dims, strict=True)]) > 0
        out = per.select(*IJK, F.when(border, n((0, 0, 0))).otherwise(moved).alias("v"))
    return out


def dilate_sparse(voxels: DataFrame, background: float) -> DataFrame:
    """Adds the six neighbours: least of the contributors, for a new cell at most the background."""
    rows = shifted(voxels, ((0, 0, 0), *FACES), "v")
    own = F.max((F.col("di") == 0) & (F.col("dj") == 0) & (F.col("dk") == 0)).alias("own")
    per = rows.groupBy(*IJK).agg(F.min("v").alias("v"), own)
    bg = F.lit(background).cast(voxels.schema["v"].dataType)
    return per.select(*IJK, F.when(F.col("own"), F.col("v")).otherwise(F.least(F.col("v"), bg)).alias("v"))


def erode_sparse(voxels: DataFrame) -> DataFrame:
    """Keeps voxels with all six neighbours; the largest of the seven."""
    per = shifted(voxels, ((0, 0, 0), *FACES), "v").groupBy(*IJK).agg(F.max("v").alias("v"), F.count("*").alias("n"))
    own = voxels.select(*IJK)
    return per.where("n = 7").join(own, list(IJK), "left_semi").select(*IJK, "v")


def morph_active(voxels: DataFrame, op: str) -> DataFrame:
    """voxels: i, j, k, v, active. Seven-point least or largest over what is stored, for active voxels alone."""
    pick = {"dilate": F.min, "erode": F.max}[op]
    per = shifted(voxels, ((0, 0, 0), *FACES), "v").groupBy(*IJK).agg(pick("v").alias("_m"))
    return voxels.join(per, list(IJK)).select(*IJK, F.when(F.col("active"), F.col("_m")).otherwise(F.col("v")).alias("v"), "active")


def _kernel_column(kernel: dict[tuple[int, int, int], float]) -> Column:
    return F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("dk"), F.lit(w).alias("w")) for (a, b, c), w in kernel.items()))


def sparse_conv3d(voxels: DataFrame, kernel: dict[tuple[int, int, int], float], pad: float = 0.0) -> DataFrame:
    """The same topology; tap o of a target reads the voxel at target + o, or pad where there is none."""
    live = {o: w for o, w in kernel.items() if w}
    rows = voxels.select(*IJK, F.col("v").cast("double").alias("v"), F.explode(_kernel_column(live)).alias("o"))
    sent = rows.select(
        *((F.col(c) - F.col(f"o.{d}")).alias(c) for c, d in zip(IJK, ("di", "dj", "dk"), strict=True)), ((F.col("v") - pad) * F.col("o.w")).alias("p")
    )
    got = sent.groupBy(*IJK).agg(F.sum("p").alias("p"))
    base = sum(live.values()) * pad
    return voxels.select(*IJK).join(got, list(IJK), "left").select(*IJK, (F.coalesce("p", F.lit(0.0)) + base).alias("v"))


def sparse_conv3d_channels(voxels: DataFrame, kernel: DataFrame) -> DataFrame:
    """voxels: i, j, k, ci, v; kernel: di, dj, dk, ci, co, w (small). Gives i, j, k, co, v on the same topology."""
    sent = voxels.join(F.broadcast(kernel), "ci").select(
        *((F.col(c) - F.col(d)).alias(c) for c, d in zip(IJK, ("di", "dj", "dk"), strict=True)), "co", (F.col("v") * F.col("w")).alias("p")
    )
    got = sent.groupBy(*IJK, "co").agg(F.sum("p").alias("v"))
    return got.join(voxels.select(*IJK).distinct(), list(IJK), "left_semi")


def offset_active(voxels: DataFrame, distance: float) -> DataFrame:
    return voxels.withColumn("v", F.col("v") + F.lit(distance).cast(voxels.schema["v"].dataType))
