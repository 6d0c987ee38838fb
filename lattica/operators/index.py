"""Coordinates, Morton codes, membership and neighbour queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..model import FACES, IJK, NEAR26, shifted


def world_to_ijk(points: DataFrame, origin=(0.0, 0.0, 0.0), size=(1.0, 1.0, 1.0)) -> DataFrame:
    """Adds i, j, k: floor((p - origin) / size) in float, 0 where an int cannot hold it."""
    out = points
    for axis, name, o, s in zip("xyz", IJK, origin, size, strict=True):
        cell = F.floor((F.col(axis).cast("float") - F.lit(o).cast("float")) / F.lit(s).cast("float"))
        fits = cell.between(-(1 << 31), (1 << 31) - 1)
        out = out.withColumn(name, F.coalesce(F.when(fits, cell), F.lit(0)).cast("int"))
    return out


def ijk_to_world(cells: DataFrame, origin=(0.0, 0.0, 0.0), size=(1.0, 1.0, 1.0)) -> DataFrame:
    """Adds x, y, z: the centre of each cell."""
    out = cells
    for axis, name, o, s in zip("xyz", IJK, origin, size, strict=True):
        out = out.withColumn(axis, F.lit(o) + (F.col(name) + 0.5) * F.lit(s))
    return out


def _spread(c: Column) -> Column:
    """21 bits with two zeros after each."""
    x = c.cast("long")
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _gather(c: Column) -> Column:
    x = c.bitwiseAND(F.lit(0x1249249249249249))
    for shift, mask in ((2, 0x10C30C30C30C30C3), (4, 0x100F00F00F00F00F), (8, 0x1F0000FF0000FF), (16, 0x1F00000000FFFF), (32, 0x1FFFFF)):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
    return x


BIAS = 1 << 20


def morton_encode(i: Column, j: Column, k: Column) -> Column:
    """Z-order of 21 bits an axis, each biased by 2^20, i lowest."""
    x, y, z = (_spread(c.cast("long") + BIAS) for c in (i, j, k))
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def morton_decode(code: Column) -> list[Column]:
    return [(_gather(F.shiftrightunsigned(code, n)) - BIAS).cast("int").alias(name) for n, name in enumerate(IJK)]


def voxelize_points(points: DataFrame, *order: str) -> DataFrame:
    """Distinct cells of points with i, j, k, and the order key of the first point in each."""
    return points.groupBy(*IJK).agg(F.min(F.struct(*order)).alias("first")).select(*IJK, *(F.col(f"first.{c}").alias(c) for c in order))


def coords_in_set(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds found: whether the coordinate is among cells."""
    known = cells.select(*IJK).distinct().withColumn("_there", F.lit(True))
    return queries.join(known, list(IJK), "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")


def ijk_to_index(queries: DataFrame, cells: DataFrame, order: str = "ord") -> DataFrame:
    """Adds index: the first place of the coordinate in the ordered cells, or -1. The order column holds the places."""
    first = cells.groupBy(*IJK).agg(F.min(order).alias("_first"))
    return queries.join(first, list(IJK), "left").withColumn("index", F.coalesce("_first", F.lit(-1))).drop("_first")


def ordered(cells: DataFrame, *by: str) -> DataFrame:
    """Adds ord: each row's place from 0. Places come from range-sorted slices and the slices' sizes, so no task sees all."""
    # Cut here: the sizes and the rows below must see one and the same slicing.
    placed = cut(cells.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per slice
    out = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn("ord", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def neighbor_counts(cells: DataFrame, connectivity: int = 6) -> DataFrame:
    """n: how many of the 6 or 26 neighbours of each active cell are active."""
    offsets = FACES if connectivity == 6 else NEAR26
    seen = shifted(cells.select(*IJK), offsets).groupBy(*IJK).agg(F.count("*").alias("n"))
    return cells.select(*IJK).join(seen, list(IJK), "left").select(*IJK, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
