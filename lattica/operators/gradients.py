"""Gradient companions: what a change of the output means for the inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import IJK
from .sampling import _finite, _linear, _parabola, _taps, trilinear


def conv3d_vjp_values(grads: DataFrame, kernel: dict[tuple[int, int, int], float], topology: DataFrame) -> DataFrame:
    """grads: i, j, k, g of the outputs. The values' gradient: each tap sends back along itself."""
    taps = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("dk"), F.lit(w).alias("w")) for (a, b, c), w in kernel.items() if w))
    rows = grads.select(*IJK, "g", F.explode(taps).alias("o"))
    sent = rows.select(*((F.col(c) + F.col(f"o.{d}")).alias(c) for c, d in zip(IJK, ("di", "dj", "dk"), strict=True)), (F.col("g") * F.col("o.w")).alias("p"))
    got = sent.groupBy(*IJK).agg(F.sum("p").alias("v"))
    return topology.select(*IJK).join(got, list(IJK), "left").select(*IJK, F.coalesce("v", F.lit(0.0)).alias("v"))


def conv3d_vjp_kernel(grads: DataFrame, voxels: DataFrame, offsets, pad: float = 0.0) -> DataFrame:
    """di, dj, dk, w: for each tap the sum of g times what the tap read."""
    taps = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("dk")) for a, b, c in offsets))
    rows = grads.select(*IJK, "g", F.explode(taps).alias("o"))
    asked = rows.select(*((F.col(c) + F.col(f"o.{d}")).alias(c) for c, d in zip(IJK, ("di", "dj", "dk"), strict=True)), "g", "o.di", "o.dj", "o.dk")
    met = asked.join(voxels.select(*IJK, F.col("v").cast("double").alias("v")), list(IJK), "left")
    return met.groupBy("di", "dj", "dk").agg(F.sum(F.col("g") * F.coalesce("v", F.lit(pad))).alias("w"))


def sample_vjp_grid(points: DataFrame, dims, order: int = 1, origin=(0.0, 0.0, 0.0), size=1.0) -> DataFrame:
    """points: x, y, z, g. The grid's gradient; taps beyond the border add to the border cells, as the sampler reads them."""
    low, high, weights = (0, 1, _linear) if order == 1 else (-1, 1, _parabola)
    spread = _taps(points.select("x", "y", "z", "g"), dims, origin, size, low, high, weights)
    return spread.groupBy(*IJK).agg(F.sum(F.col("_w") * F.col("g")).alias("v"))


def sample_vjp_points(points: DataFrame, key: str, voxels: DataFrame, dims, origin=(0.0, 0.0, 0.0), size=1.0) -> DataFrame:
    """key, gx, gy, gz: what a move of each point changes. points: key, x, y, z, g (of the sampled value).

    The taps are the sampler's. Along the axis of the derivative a tap weighs -1 or 1, along the others as in the sampler, so
    at the border, where both taps read one cell, the change is 0. A point that is not finite has no gradient.
    """
    slope = lambda f: [F.lit(-1.0 / size), F.lit(1.0 / size)]
    taps = _taps(points.select(key, "x", "y", "z", "g"), dims, origin, size, 0, 1, _linear, {f"_d{c}": (c, slope) for c in IJK})
    met = taps.join(voxels.select(*IJK, F.col("v").cast("double").alias("_v")), list(IJK), "left")
    part = lambda c: F.sum(F.col(f"_d{c}") * F.coalesce("_v", F.lit(0.0)) * F.col("g"))
    got = met.groupBy(key).agg(*(part(c).alias(f"g{x}") for c, x in zip(IJK, "xyz", strict=True)))
    fine = points.select(key, _finite(*(F.col(x).cast("double") for x in "xyz")).alias("_fine"))
    return fine.join(got, key).select(key, *(F.when(F.col("_fine"), F.col(f"g{x}")).otherwise(0.0).alias(f"g{x}") for x in "xyz"))


def splat_vjp_values(points: DataFrame, key: str, grads: DataFrame, dims, origin=(0.0, 0.0, 0.0), size=1.0) -> DataFrame:
    """key, g: splatting is the transpose of sampling, so a value's gradient is the gradient grid (i, j, k, g) sampled there."""
    return trilinear(points, key, grads.select(*IJK, "g"), dims, origin, size, values=("g",))


def _csg_vjp(a: DataFrame, b: DataFrame, grads: DataFrame, order, sign: float) -> DataFrame:
    """The side that gives the result gets the gradient; where both do, half each. order(va, vb) > 0: a gives it."""
    met = a.select(*IJK, F.col("v").alias("_a")).join(b.select(*IJK, F.col("v").alias("_b")), list(IJK)).join(grads, list(IJK))
    lead = F.signum(order(F.col("_a").cast("double"), F.col("_b").cast("double")))
    part = (lead + 1) / 2
    return met.select(*IJK, (part * F.col("g")).alias("ga"), ((1 - part) * sign * F.col("g")).alias("gb"))


def csg_union_vjp(a: DataFrame, b: DataFrame, grads: DataFrame) -> DataFrame:
    """i, j, k, ga, gb of min(a, b)."""
    return _csg_vjp(a, b, grads, lambda x, y: y - x, 1.0)


def csg_intersection_vjp(a: DataFrame, b: DataFrame, grads: DataFrame) -> DataFrame:
    """i, j, k, ga, gb of max(a, b)."""
    return _csg_vjp(a, b, grads, lambda x, y: x - y, 1.0)


def csg_difference_vjp(a: DataFrame, b: DataFrame, grads: DataFrame) -> DataFrame:
    """i, j, k, ga, gb of max(a, -b)."""
    return _csg_vjp(a, b, grads, lambda x, y: x + y, -1.0)


def laplacian_vjp(grads: DataFrame, dims, size: float = 1.0) -> DataFrame:
    """The border-replicating Laplacian is its own transpose."""
    from .stencil import laplacian

    return laplacian(grads.select(*IJK, F.col("g").alias("v")), size)


def jagged_sum_vjp(lists: DataFrame, grads: DataFrame) -> DataFrame:
    """grads: list_id, ch, g. Each element gets its list's gradient."""
    return lists.join(grads, ["list_id", "ch"]).drop("v")


def max_pool_vjp(dense: DataFrame, factor, grads: DataFrame) -> DataFrame:
    """grads: i, j, k of blocks, g. The gradient goes to the first largest cell of each block in scan order."""
    block = [F.floor(F.col(c) / f).cast("int").alias(f"b{c}") for c, f in zip(IJK, factor, strict=True)]
    best = dense.select(*IJK, "v", *block).groupBy("bi", "bj", "bk").agg(F.min_by(F.struct(*IJK), F.struct(-F.col("v"), F.col("k"), F.col("j"), F.col("i"))).alias("c"))
    named = grads.select(*(F.col(c).alias(f"b{c}") for c in IJK), "g")
    return best.join(named, ["bi", "bj", "bk"]).select(*(F.col(f"c.{c}").alias(c) for c in IJK), F.col("g").alias("v"))
