"""Aggregations, diagnostics, pooling, jagged lists and batches of grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import IJK


def grid_statistics(voxels: DataFrame) -> DataFrame:
    v = F.col("v").cast("double")
    return voxels.agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"),
        F.sum(v).alias("sum"), F.count("v").alias("count"),
    )


def grid_histogram(voxels: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """bin, n for every bin; values outside go to the end bins, NaN to none."""
    v = F.col("v").cast("double")
    x = (v / 2 - low / 2) / (high / 2 - low / 2) * bins  # halves, so that no span overflows
    at = F.greatest(F.lit(0.0), F.least(F.lit(bins - 1.0), F.floor(x).cast("double"))).cast("int")
    counted = voxels.where(F.col("v").isNotNull() & ~F.isnan(v)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = voxels.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def check_level_set(gradients: DataFrame, band: float, tolerance: float) -> DataFrame:
    """gradients: v and gx, gy, gz of interior voxels. How far their length is from 1 within the band."""
    size = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2)
    error = F.abs(size - 1)
    return gradients.where(F.abs("v") <= band).agg(
        F.avg(size).alias("mean_gradient"), F.max(error).alias("max_error"),
        F.avg((error > tolerance).cast("double")).alias("bad_part"), F.count("*").alias("n"),
    )


def check_fog_volume(voxels: DataFrame, eps: float = 1e-6) -> DataFrame:
    v = F.col("v").cast("double")
    infinite = F.isnan(v) | (F.abs(v) == float("inf"))
    known = F.when(~F.isnan(v), v)
    return voxels.agg(
        F.min(known).alias("lo"), F.max(known).alias("hi"), F.count(F.when(infinite, 1)).alias("nonfinite"),
        F.coalesce(F.bool_and(~infinite & v.between(-eps, 1 + eps)), F.lit(True)).alias("valid"),
    )


def surface_area(dense: DataFrame, size: float = 1.0) -> DataFrame:
    """Sign changes over the faces towards +i, +j, +k, times the face's area. One pass: each voxel meets its own shifted self."""
    inner = (F.col("v") < 0).alias("inn")
    here = F.struct(F.lit(0).alias("axis"), *(F.col(c).alias(c) for c in IJK), inner)
    next_ = [F.struct(F.lit(n + 1).alias("axis"), *((F.col(c) - 1 if m == n else F.col(c)).alias(c) for m, c in enumerate(IJK)), inner) for n in range(3)]
    rows = dense.select(F.explode(F.array(here, *next_)).alias("r")).select("r.*")
    per = rows.groupBy(*IJK).agg(
        F.max(F.when(F.col("axis") == 0, F.col("inn"))).alias("c"), *(F.max(F.when(F.col("axis") == n, F.col("inn"))).alias(f"n{n}") for n in (1, 2, 3))
    )
    changed = sum(F.coalesce((F.col("c") != F.col(f"n{n}")).cast("long"), F.lit(0)) for n in (1, 2, 3))
    return per.agg(F.sum(changed).alias("faces")).select("faces", (F.col("faces") * (size * size)).alias("area"))


def volume(dense: DataFrame, size: float = 1.0) -> DataFrame:
    return dense.agg((F.count(F.when(F.col("v") < 0, 1)) * (size**3)).alias("volume"))


def active_bbox(voxels: DataFrame) -> DataFrame:
    """The least coordinates and, exclusive, the largest."""
    return voxels.agg(*(F.min(c).alias(f"min_{c}") for c in IJK), *((F.max(c) + 1).alias(f"max_{c}") for c in IJK))


def active_voxel_count(voxels: DataFrame, tiles: DataFrame | None = None) -> DataFrame:
    """tiles: span, active; each counts as span^3 voxels."""
    n = voxels.agg(F.count("*").alias("n"))
    if tiles is None:
        return n
    more = tiles.where("active").agg(F.coalesce(F.sum(F.col("span").cast("long") * F.col("span") * F.col("span")), F.lit(0)).alias("m"))
    return n.crossJoin(F.broadcast(more)).select((F.col("n") + F.col("m")).alias("n"))  # one row each


def grid_info(voxels: DataFrame, by: str = "grid_id") -> DataFrame:
    """Per grid: inclusive bounds and the number of active voxels."""
    bounds = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in IJK]
    return voxels.groupBy(by).agg(*bounds, F.count("*").alias("active"))


def diagnose(voxels: DataFrame, low: float, high: float) -> DataFrame:
    """Counts of values that are not finite or out of range, and the first such coordinate."""
    v = F.col("v").cast("double")
    infinite = F.isnan(v) | (F.abs(v) == float("inf"))
    bad = infinite | ~v.between(low, high)
    first = F.min(F.when(bad, F.struct(*IJK)))
    out = voxels.agg(
        F.count(F.when(infinite, 1)).alias("nonfinite"), F.count(F.when(~infinite & ~v.between(low, high), 1)).alias("out_of_range"),
        first.alias("first"), F.count("*").alias("active"),
    )
    return out.select("nonfinite", "out_of_range", *(F.col(f"first.{c}").alias(f"first_{c}") for c in IJK), "active")


def pool(dense: DataFrame, factor: tuple[int, int, int], op: str) -> DataFrame:
    """op: max or avg over blocks; partial blocks at the far side count with what they hold."""
    block = [F.floor(F.col(c) / f).cast("int").alias(c) for c, f in zip(IJK, factor, strict=True)]
    made = {"max": F.max("v"), "avg": F.avg(F.col("v").cast("double")), "min": F.min("v")}[op]
    return dense.groupBy(*block).agg(made.alias("v"))


def strided_window(dense: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int], stride: int, background: float, inactive: bool = True) -> DataFrame:
    """Box averages of a window of a grid (active column); inactive voxels count as background."""
    rows = dense
    for c, a, b in zip(IJK, low, high, strict=True):
        rows = rows.where(F.col(c).between(a, b - 1))
    value = F.when(F.col("active"), F.col("v")).otherwise(F.lit(background)) if inactive else F.col("v")
    block = [F.floor((F.col(c) - a) / stride).cast("int").alias(c) for c, a in zip(IJK, low, strict=True)]
    return rows.groupBy(*block).agg(F.avg(value.cast("double")).alias("v"))


def jagged_reduce(lists: DataFrame, op: str, every: DataFrame | None = None) -> DataFrame:
    """lists: list_id, ch, v. Per list and channel; lists of `every` (list_id, ch) without elements give 0."""
    v = F.col("v").cast("double")
    made = {"sum": F.sum(v), "mean": F.avg(v), "max": F.max(v), "min": F.min(v)}[op].alias("v")
    out = lists.groupBy("list_id", "ch").agg(made)
    if every is None:
        return out
    return every.select("list_id", "ch").join(out, ["list_id", "ch"], "left").select("list_id", "ch", F.coalesce("v", F.lit(0.0)).alias("v"))


def jagged_sizes(lists: DataFrame) -> DataFrame:
    return lists.groupBy("list_id").agg(F.count("*").alias("n"))


def jagged_from_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """list_id, values: each list as an array in order. A list is one row by its nature."""
    packed = rows.groupBy("list_id").agg(F.sort_array(F.collect_list(F.struct(*order, "v"))).alias("p"))
    return packed.select("list_id", F.transform("p", lambda x: x["v"]).alias("values"))


def jagged_concat(a: DataFrame, b: DataFrame, shift: int | Column) -> DataFrame:
    """b's lists follow a's: their ids move by shift (the number of a's lists)."""
    return a.unionByName(b.withColumn("list_id", F.col("list_id") + shift))


def grid_batch(*grids: DataFrame) -> DataFrame:
    """Grids under one another with their number."""
    out = None
    for n, g in enumerate(grids):
        part = g.select(F.lit(n).alias("grid_id"), *IJK, "v")
        out = part if out is None else out.unionByName(part)
    return out
