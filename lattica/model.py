"""The relational model: voxels(i, j, k, v), and how the driver's tables become voxels, points and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IJK = ("i", "j", "k")
FACES = ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))
CUBE = tuple((a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))
NEAR26 = tuple(o for o in CUBE if o != (0, 0, 0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offsets_column(offsets: Sequence[tuple[int, int, int]]) -> Column:
    """A literal array of offsets, to be exploded beside each row; it adds no join."""
    return F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("dk")) for a, b, c in offsets))


def shifted(voxels: DataFrame, offsets: Sequence[tuple[int, int, int]], *carry: str) -> DataFrame:
    """One row for each voxel and offset, at the voxel's coordinate plus the offset."""
    rows = voxels.select(*IJK, *carry, F.explode(offsets_column(offsets)).alias("o"))
    return rows.select(
        (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), (F.col("k") + F.col("o.dk")).alias("k"),
        *carry, F.col("o.di").alias("di"), F.col("o.dj").alias("dj"), F.col("o.dk").alias("dk"),
    )


def inside(dims: tuple[int, int, int]) -> Column:
    return (
        F.col("i").between(0, dims[0] - 1) & F.col("j").between(0, dims[1] - 1) & F.col("k").between(0, dims[2] - 1)
    )


def box(spark: SparkSession, dims: tuple[int, int, int]) -> DataFrame:
    """All cells of a box, made in parallel from one range."""
    nx, ny, nz = dims
    n = F.col("id")
    return spark.range(nx * ny * nz).select(
        (n % nx).cast("int").alias("i"), (F.floor(n / nx) % ny).cast("int").alias("j"), F.floor(n / (nx * ny)).cast("int").alias("k")
    )


# The driver's tables as inputs.

DENSE_DIMS = (11, 11, 9)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"), F.col("l_tax").cast("double").alias("z"),
        F.col("l_extendedprice").cast("float").alias("v"), "l_orderkey", "l_linenumber",
    )


def lattice(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """A sparse grid: the least price of each cell, for one return flag."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    keyed = rows.select(
        F.floor("l_quantity").cast("int").alias("i"), F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("j"),
        F.floor(F.col("l_discount") * 100).cast("int").alias("k"), F.col("l_extendedprice").cast("float").alias("v"),
    )
    return keyed.groupBy(*IJK).agg(F.min("v").alias("v"))


def box_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = points(spark, sf_dir).select(
        F.floor(F.col("x") / 5).cast("int").alias("i"), F.floor(F.col("y") * 100).cast("int").alias("j"),
        F.floor(F.col("z") * 100).cast("int").alias("k"), "v",
    )
    return keyed.groupBy(*IJK).agg(F.min("v").alias("v"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full box of doubles with both signs; cells without a point are 3."""
    value = F.coalesce(F.col("v").cast("double") / 1000 - 20, F.lit(3.0)).alias("v")
    return box(spark, DENSE_DIMS).join(box_voxels(spark, sf_dir), list(IJK), "left").select(*IJK, value)


_LATTICE_SQL = """SELECT CAST(floor(l_quantity) AS INT) AS i, CAST(floor(l_extendedprice / 1000) AS INT) AS j,
    CAST(floor(l_discount * 100) AS INT) AS k, min(CAST(l_extendedprice AS FLOAT)) AS v
    FROM lineitem WHERE l_returnflag = '{}' GROUP BY 1, 2, 3"""
A_SQL = f"a AS ({_LATTICE_SQL.format('R')})"
B_SQL = f"b AS ({_LATTICE_SQL.format('A')})"
VOX_SQL = """vox AS (SELECT CAST(floor(l_quantity / 5) AS INT) AS i, CAST(floor(l_discount * 100) AS INT) AS j,
    CAST(floor(l_tax * 100) AS INT) AS k, min(CAST(l_extendedprice AS FLOAT)) AS v FROM lineitem GROUP BY 1, 2, 3)"""
DENSE_SQL = f"""{VOX_SQL}, dense AS (SELECT CAST(x.i AS INT) AS i, CAST(y.j AS INT) AS j, CAST(z.k AS INT) AS k,
    coalesce(CAST(vox.v AS DOUBLE) / 1000 - 20, 3.0) AS v
    FROM range(0, 11) x(i) CROSS JOIN range(0, 11) y(j) CROSS JOIN range(0, 9) z(k)
    LEFT JOIN vox ON vox.i = x.i AND vox.j = y.j AND vox.k = z.k)"""


def offsets_sql(offsets: Sequence[tuple[int, int, int]], name: str = "o") -> str:
    return f"{name}(di, dj, dk) AS (VALUES {', '.join(map(str, offsets))})"
