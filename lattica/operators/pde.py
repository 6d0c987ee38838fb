"""The Poisson equation on the active topology, by preconditioned conjugate gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..model import FACES, IJK, shifted


def _apply(state: DataFrame, value: str, name: str) -> DataFrame:
    """Adds name: degree * value - the neighbours' values, over the topology of state."""
    around = shifted(state, FACES, value).groupBy(*IJK).agg(F.sum(value).alias("_n"))
    joined = state.join(around, list(IJK), "left")
    return joined.withColumn(name, F.col("deg") * F.col(value) - F.coalesce("_n", F.lit(0.0))).drop("_n")


def _number(df: DataFrame, c: Column) -> float:
    return df.agg(F.sum(c).alias("s")).first()["s"] or 0.0


def solve_poisson(rhs: DataFrame, size: float = 1.0, tolerance: float = 1e-8, most: int = 200) -> DataFrame:
    """i, j, k, u with -laplacian(u) = v and no flux through the border of the topology; v's mean is taken out, u has mean 0.

    Jacobi-preconditioned. Every iteration is one scatter and three sums; the driver holds those three numbers. The state is
    checkpointed each iteration, in the shared folder.
    """
    cells = rhs.select(*IJK, F.col("v").cast("double").alias("v"))
    degree = shifted(cells.select(*IJK), FACES).groupBy(*IJK).agg(F.count("*").alias("deg"))
    mean = cells.agg(F.avg("v")).first()[0] or 0.0
    state = cells.join(degree, list(IJK), "left").select(*IJK, F.coalesce(F.col("deg").cast("double"), F.lit(0.0)).alias("_d"), ((F.col("v") - mean) * size * size).alias("r"))
    own = shifted(state.select(*IJK), FACES).groupBy(*IJK).agg(F.count("*").cast("double").alias("deg"))
    state = state.drop("_d").join(own, list(IJK), "left").withColumn("deg", F.coalesce("deg", F.lit(0.0)))
    over = F.when(F.col("deg") > 0, F.col("r") / F.col("deg")).otherwise(0.0)
    state = cut(state.withColumn("u", F.lit(0.0)).withColumn("z", over).withColumn("p", F.col("z")))
    rz, first = _number(state, F.col("r") * F.col("z")), _number(state, F.col("r") * F.col("r"))
    for _ in range(most):
        if first == 0 or rz == 0:
            break
        state = cut(_apply(state, "p", "q"))
        alpha = rz / _number(state, F.col("p") * F.col("q"))
        state = state.withColumn("u", F.col("u") + alpha * F.col("p")).withColumn("r", F.col("r") - alpha * F.col("q")).withColumn("z", over)
        sums = state.agg(F.sum(F.col("r") * F.col("z")).alias("rz"), F.sum(F.col("r") * F.col("r")).alias("rr")).first()
        if sums["rr"] <= tolerance * tolerance * first:
            break
        state = state.withColumn("p", F.col("z") + (sums["rz"] / rz) * F.col("p"))
        rz = sums["rz"]
    centre = state.agg(F.avg("u")).first()[0] or 0.0
    return state.select(*IJK, (F.col("u") - centre).alias("u"))
