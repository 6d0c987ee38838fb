"""Constructive solid geometry, set operations and conversions between sparse and dense grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import IJK


def pick_less(a: Column, b: Column) -> Column:
    """a if a < b, else b: with a NaN on either side b, as a comparison gives it."""
    return F.when(F.isnan(a) | F.isnan(b), b).otherwise(F.least(a, b))


def pick_more(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), b).otherwise(F.greatest(a, b))


PICK = {
    "union": pick_less,
    "intersection": pick_more,
    "difference": lambda a, b: pick_more(a, -b),
}


def _named(df: DataFrame, to: str) -> DataFrame:
    return df.select(*IJK, F.col("v").alias(to))


def csg_sparse(a: DataFrame, b: DataFrame, op: str, background: float) -> DataFrame:
    """All coordinates of either grid (for every operation); a missing side is the background."""
    both = _named(a, "_a").join(_named(b, "_b"), list(IJK), "full")
    kind = a.schema["v"].dataType
    bg = F.lit(background).cast(kind)
    return both.select(*IJK, PICK[op](F.coalesce("_a", bg), F.coalesce("_b", bg)).cast(kind).alias("v"))


def csg_dense(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Grids of one frame, voxel by voxel."""
    return _named(a, "_a").join(_named(b, "_b"), list(IJK)).select(*IJK, PICK[op](F.col("_a"), F.col("_b")).alias("v"))


def comp(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """op: max, min, sum or mult."""
    x, y = F.col("_a"), F.col("_b")
    made = {"max": pick_more(x, y), "min": pick_less(x, y), "sum": x + y, "mult": x * y}[op]
    return _named(a, "_a").join(_named(b, "_b"), list(IJK)).select(*IJK, made.alias("v"))


def extend_from_sparse(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both topologies; where both have a value the new one wins."""
    both = _named(old, "_old").join(_named(new, "_new"), list(IJK), "full")
    return both.select(*IJK, F.coalesce("_new", "_old").alias("v"))


def leaf_key(*shift: int) -> list[Column]:
    bits = shift[0] if shift else 3
    return [F.shiftright(c, bits).alias(f"l{c}") for c in IJK]


def update_from_sparse(old: DataFrame, new: DataFrame) -> DataFrame:
    """New values where their leaf (8 cells a side) exists; others are skipped. active tells rows that were there before."""
    leaves = old.select(*leaf_key()).distinct()
    kept = new.select(*IJK, "v", *leaf_key()).join(leaves, ["li", "lj", "lk"], "left_semi")
    both = _named(old, "_old").join(_named(kept, "_new"), list(IJK), "full")
    return both.select(*IJK, F.coalesce("_new", "_old").alias("v"), F.col("_old").isNotNull().alias("active"))


def update_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """updated, skipped: rows of new with and without an existing leaf."""
    leaves = old.select(*leaf_key()).distinct().withColumn("_leaf", F.lit(1))
    marked = new.select(*leaf_key()).join(leaves, ["li", "lj", "lk"], "left")
    return marked.agg(F.count("_leaf").alias("updated"), (F.count("*") - F.count("_leaf")).alias("skipped"))


def first_wins(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per coordinate: the first by order. A min over structs, so duplicates shrink before they travel.

    Of rows that tie in order any one wins; name a total order (the value last, say) where that matters.
    """
    best = rows.groupBy(*IJK).agg(F.min_by("v", F.struct(*order)).alias("v"))
    return best.select(*IJK, "v")


def with_tree_keys(rows: DataFrame) -> DataFrame:
    """The leaf, lower and upper node of each voxel in a 5/4/3 tree."""
    keys = [F.shiftright(c, bits).alias(f"{level}_{c}") for level, bits in (("leaf", 3), ("lower", 7), ("upper", 12)) for c in IJK]
    return rows.select("*", *keys)


def sparse_to_dense(cells: DataFrame, voxels: DataFrame, background: float) -> DataFrame:
    """cells: the box. Voxels outside it are dropped."""
    return cells.select(*IJK).join(voxels.select(*IJK, "v"), list(IJK), "left").select(*IJK, F.coalesce("v", F.lit(background)).alias("v"))


def dense_to_sparse(dense: DataFrame, background: float, tolerance: float = 0.0) -> DataFrame:
    return dense.where(F.abs(F.col("v") - background) > tolerance)


def prune_grid(dense: DataFrame, background: float, tolerance: float) -> DataFrame:
    """Snaps values within the tolerance to the background."""
    near = F.abs(F.col("v") - background) <= tolerance
    return dense.withColumn("v", F.when(near, F.lit(background)).otherwise(F.col("v")))


def clip_grid(dense: DataFrame, dims, low, high) -> DataFrame:
    """The world box [low, high] of a grid with unit cells: floor and ceil, clamped to the grid, moved to 0."""
    import math

    out = dense
    for name, n, a, b in zip(IJK, dims, low, high, strict=True):
        lo, hi = max(0, math.floor(a)), min(n, math.ceil(b))
        if lo >= hi:
            raise ValueError("the box does not meet the grid")
        out = out.where(F.col(name).between(lo, hi - 1)).withColumn(name, (F.col(name) - lo).cast("int"))
    return out


def merge_grids(a: DataFrame, b: DataFrame, shift: tuple[int, int, int]) -> DataFrame:
    """b lies `shift` cells from a: the lesser value where they overlap."""
    moved = b.select(*((F.col(c) + s).cast("int").alias(c) for c, s in zip(IJK, shift, strict=True)), "v")
    both = _named(a, "_a").join(_named(moved, "_b"), list(IJK), "full")
    return both.select(*IJK, F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(pick_less(F.col("_a"), F.col("_b"))).alias("v"))


def fracture(solid: DataFrame, cutters: DataFrame) -> DataFrame:
    """piece, i, j, k, v. cutters: piece, i, j, k, v on the solid's frame. Each piece max(in, cutter); piece -1 the rest."""
    cut = solid.select(*IJK, F.col("v").alias("_in")).join(cutters.select("piece", *IJK, F.col("v").alias("_c")), list(IJK))
    pieces = cut.select("piece", *IJK, F.greatest("_in", "_c").alias("v"))
    rest = cut.groupBy(*IJK).agg(F.first("_in").alias("_in"), F.min("_c").alias("_m"))
    return pieces.unionByName(rest.select(F.lit(-1).alias("piece"), *IJK, F.greatest(F.col("_in"), -F.col("_m")).alias("v")))


def visit_leaves(voxels: DataFrame) -> DataFrame:
    """Per leaf: count, least, largest, sum of its active voxels."""
    return voxels.groupBy(*leaf_key()).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(F.col("v").cast("double")).alias("total")
    )


def mask_rank(cells: DataFrame) -> DataFrame:
    """The place of each active voxel among those of its leaf, in slot order (i highest, k lowest)."""
    slot = sum(F.shiftleft(F.col(c).bitwiseAND(F.lit(7)), n) for c, n in zip(IJK, (6, 3, 0), strict=True))
    rows = cells.select(*IJK, *leaf_key(), slot.alias("slot"))
    within = Window.partitionBy("li", "lj", "lk").orderBy("slot")  # 512 rows at most
    return rows.select(*IJK, "slot", (F.row_number().over(within) - 1).cast("int").alias("rank"))


def prune_tiles(dense: DataFrame, bits: int = 3) -> DataFrame:
    """Nodes whose cells are all there and equal become tiles; the others stay voxels. level 1 for tiles, 0 for voxels."""
    node = [F.shiftright(c, bits).alias(f"l{c}") for c in IJK]
    per = dense.groupBy(*node).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    full = per.where((F.col("n") == 1 << 3 * bits) & (F.col("lo") == F.col("hi")))
    tiles = full.select(*(F.shiftleft(f"l{c}", bits).cast("int").alias(c) for c in IJK), F.col("lo").alias("v"), F.lit(1).alias("level"))
    rest = dense.select(*IJK, "v", *node).join(full.select("li", "lj", "lk"), ["li", "lj", "lk"], "left_anti")
    return tiles.unionByName(rest.select(*IJK, "v", F.lit(0).alias("level")))
