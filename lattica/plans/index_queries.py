"""Queries over coordinates, membership, combination and conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import A_SQL, B_SQL, DENSE_DIMS, DENSE_SQL, FACES, IJK, NEAR26, VOX_SQL, box, box_voxels, dense, lattice, offsets_sql, points
from ..operators import combine, index
from .registry import register

_SIZE = (5.0, 0.01, 0.01)
_PTS = """pts AS (SELECT l_quantity AS x, l_discount AS y, l_tax AS z, l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem)"""


@register("world_to_ijk", f"""WITH {_PTS} SELECT l_orderkey, l_linenumber, CAST(floor((CAST(x AS FLOAT) - CAST(0 AS FLOAT)) / CAST(5 AS FLOAT)) AS INT) AS i,
    CAST(floor(CAST(price AS FLOAT) / CAST(1000 AS FLOAT)) AS INT) AS j, CAST(floor(CAST(z AS FLOAT) / CAST(0.25 AS FLOAT)) AS INT) AS k FROM pts""")
def world_to_ijk(spark, sf_dir):
    rows = points(spark, sf_dir).withColumn("y", F.col("v"))
    return index.world_to_ijk(rows, size=(5.0, 1000.0, 0.25)).select("l_orderkey", "l_linenumber", *IJK)


@register("ijk_to_world", f"WITH {A_SQL} SELECT i, j, k, 1.0 + (i + 0.5) * 2.0 AS x, (j + 0.5) * 0.5 AS y, -3.0 + (k + 0.5) * 1.0 AS z FROM a".replace("1.0 +", "CAST(1.0 AS DOUBLE) +").replace("2.0 AS x", "CAST(2.0 AS DOUBLE) AS x").replace("* 0.5 AS y", "* CAST(0.5 AS DOUBLE) + CAST(0 AS DOUBLE) AS y").replace("* 1.0 AS z", "* CAST(1.0 AS DOUBLE) AS z"))
def ijk_to_world(spark, sf_dir):
    return index.ijk_to_world(lattice(spark, sf_dir, "R"), (1.0, 0.0, -3.0), (2.0, 0.5, 1.0)).select(*IJK, "x", "y", "z")


_BITS = " + ".join(f"((((({c} + 1048576) >> {b}) & 1)) << {3 * b + n})" for b in range(21) for n, c in enumerate("ijk"))


@register("morton_encode", f"WITH {A_SQL}, w AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k FROM a) SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, CAST({_BITS} AS BIGINT) AS code FROM w")
def morton_encode(spark, sf_dir):
    return lattice(spark, sf_dir, "R").select(*IJK, index.morton_encode(*(F.col(c) for c in IJK)).alias("code"))


@register("morton_decode", f"WITH {A_SQL} SELECT i - 7 AS i, j, k - 4 AS k FROM a")
def morton_decode(spark, sf_dir):
    moved = lattice(spark, sf_dir, "R").select((F.col("i") - 7).alias("i"), "j", (F.col("k") - 4).alias("k"))
    return moved.select(index.morton_encode(*(F.col(c) for c in IJK)).alias("code")).select(*index.morton_decode(F.col("code")))


@register("voxelize_points", """WITH p AS (SELECT CAST(floor(l_quantity / 5) AS INT) AS i, CAST(floor(l_discount * 100) AS INT) AS j,
    CAST(floor(l_tax * 100) AS INT) AS k, l_orderkey, l_linenumber FROM lineitem)
    SELECT i, j, k, l_orderkey, l_linenumber FROM p QUALIFY row_number() OVER (PARTITION BY i, j, k ORDER BY l_orderkey, l_linenumber) = 1""")
def voxelize_points(spark, sf_dir):
    rows = points(spark, sf_dir).select(
        F.floor(F.col("x") / 5).cast("int").alias("i"), F.floor(F.col("y") * 100).cast("int").alias("j"),
        F.floor(F.col("z") * 100).cast("int").alias("k"), "l_orderkey", "l_linenumber",
    )
    return index.voxelize_points(rows, "l_orderkey", "l_linenumber")


@register("coords_in_set", f"WITH {A_SQL}, {B_SQL} SELECT a.i, a.j, a.k, b.i IS NOT NULL AS found FROM a LEFT JOIN b USING (i, j, k)".replace("SELECT a.i, a.j, a.k, b.i IS NOT NULL", "SELECT a.i, a.j, a.k, b.v IS NOT NULL"))
def coords_in_set(spark, sf_dir):
    return index.coords_in_set(lattice(spark, sf_dir, "R").select(*IJK), lattice(spark, sf_dir, "A"))


@register("points_in_set", f"""WITH {A_SQL} SELECT p_partkey, a.v IS NOT NULL AS found FROM part LEFT JOIN a
    ON a.i = CAST(p_size AS INT) AND a.j = CAST(floor(p_retailprice / 50) AS INT) AND a.k = CAST(p_partkey % 11 AS INT)""")
def points_in_set(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(
        "p_partkey", F.col("p_size").cast("int").alias("i"), F.floor(F.col("p_retailprice") / 50).cast("int").alias("j"), (F.col("p_partkey") % 11).cast("int").alias("k")
    )
    return index.coords_in_set(rows, lattice(spark, sf_dir, "R")).select("p_partkey", "found")


@register("ijk_to_index", f"""WITH {A_SQL}, {B_SQL}, o AS (SELECT i, j, k, row_number() OVER (ORDER BY k, j, i) - 1 AS ord FROM b)
    SELECT a.i, a.j, a.k, coalesce(o.ord, -1) AS "index" FROM a LEFT JOIN o ON a.i = o.i AND a.j = o.j AND a.k = o.k""")
def ijk_to_index(spark, sf_dir):
    placed = index.ordered(lattice(spark, sf_dir, "A"), "k", "j", "i")
    return index.ijk_to_index(lattice(spark, sf_dir, "R").select(*IJK), placed)


def _neighbours(offsets):
    return f"""WITH {A_SQL}, {offsets_sql(offsets)} SELECT t.i, t.j, t.k, count(s.i) AS n FROM a t CROSS JOIN o
        LEFT JOIN a s ON s.i = t.i + o.di AND s.j = t.j + o.dj AND s.k = t.k + o.dk GROUP BY 1, 2, 3"""


@register("neighbor_counts_6", _neighbours(FACES))
def neighbor_counts_6(spark, sf_dir):
    return index.neighbor_counts(lattice(spark, sf_dir, "R"), 6)


@register("neighbor_counts_26", _neighbours(NEAR26))
def neighbor_counts_26(spark, sf_dir):
    return index.neighbor_counts(lattice(spark, sf_dir, "R"), 26)


_SPARSE = {"union": "least(coalesce(a.v, bg), coalesce(b.v, bg))", "intersection": "greatest(coalesce(a.v, bg), coalesce(b.v, bg))", "difference": "greatest(coalesce(a.v, bg), -coalesce(b.v, bg))"}
for _op, _sql in _SPARSE.items():
    _full = f"""WITH {A_SQL}, {B_SQL}, g AS (SELECT CAST(30000 AS FLOAT) AS bg)
        SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, coalesce(a.k, b.k) AS k, {_sql} AS v
        FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j AND a.k = b.k CROSS JOIN g"""
    register(f"csg_{_op}", _full)(lambda spark, sf_dir, op=_op: combine.csg_sparse(lattice(spark, sf_dir, "R"), lattice(spark, sf_dir, "A"), op, 30000.0))


def _second(spark, sf_dir):
    """Another grid of the dense frame: the first with its i axis turned round and its sign turned."""
    return dense(spark, sf_dir).select((DENSE_DIMS[0] - 1 - F.col("i")).cast("int").alias("i"), "j", "k", (-F.col("v") / 2).alias("v"))


_PAIR = f"WITH {DENSE_SQL}, d2 AS (SELECT 10 - i AS i, j, k, -v / 2 AS v FROM dense) SELECT a.i, a.j, a.k, {{}} AS v FROM dense a JOIN d2 b ON a.i = b.i AND a.j = b.j AND a.k = b.k"
for _op, _sql in {"union": "least(a.v, b.v)", "intersection": "greatest(a.v, b.v)", "difference": "greatest(a.v, -b.v)"}.items():
    register(f"csg_{_op}_dense", _PAIR.format(_sql))(lambda spark, sf_dir, op=_op: combine.csg_dense(dense(spark, sf_dir), _second(spark, sf_dir), op))
for _op, _sql in {"max": "greatest(a.v, b.v)", "min": "least(a.v, b.v)", "sum": "a.v + b.v", "mult": "a.v * b.v"}.items():
    register(f"comp_{_op}", _PAIR.format(_sql))(lambda spark, sf_dir, op=_op: combine.comp(dense(spark, sf_dir), _second(spark, sf_dir), op))


@register("extend_from_sparse", f"WITH {A_SQL}, {B_SQL} SELECT coalesce(b.i, a.i) AS i, coalesce(b.j, a.j) AS j, coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j AND a.k = b.k")
def extend_from_sparse(spark, sf_dir):
    return combine.extend_from_sparse(lattice(spark, sf_dir, "R"), lattice(spark, sf_dir, "A"))


_FAR = "c AS (SELECT i, j + 40 AS j, k, v FROM b)"


def _far(spark, sf_dir):
    return lattice(spark, sf_dir, "A").withColumn("j", F.col("j") + 40)


@register("update_from_sparse", f"""WITH {A_SQL}, {B_SQL}, {_FAR}, leaf AS (SELECT DISTINCT i >> 3 AS li, j >> 3 AS lj, k >> 3 AS lk FROM a),
    n AS (SELECT c.* FROM c SEMI JOIN leaf ON c.i >> 3 = li AND c.j >> 3 = lj AND c.k >> 3 = lk)
    SELECT coalesce(n.i, a.i) AS i, coalesce(n.j, a.j) AS j, coalesce(n.k, a.k) AS k, coalesce(n.v, a.v) AS v, a.v IS NOT NULL AS active
    FROM a FULL JOIN n ON a.i = n.i AND a.j = n.j AND a.k = n.k""")
def update_from_sparse(spark, sf_dir):
    return combine.update_from_sparse(lattice(spark, sf_dir, "R"), _far(spark, sf_dir))


@register("update_counts", f"""WITH {A_SQL}, {B_SQL}, {_FAR}, leaf AS (SELECT DISTINCT i >> 3 AS li, j >> 3 AS lj, k >> 3 AS lk, 1 AS t FROM a)
    SELECT count(t) AS updated, count(*) - count(t) AS skipped FROM c LEFT JOIN leaf ON c.i >> 3 = li AND c.j >> 3 = lj AND c.k >> 3 = lk""")
def update_counts(spark, sf_dir):
    return combine.update_counts(lattice(spark, sf_dir, "R"), _far(spark, sf_dir))


@register("from_sparse_first_wins", """WITH p AS (SELECT CAST(floor(l_quantity / 5) AS INT) AS i, CAST(floor(l_discount * 100) AS INT) AS j, CAST(floor(l_tax * 100) AS INT) AS k,
    CAST(l_extendedprice AS FLOAT) AS v, l_orderkey, l_linenumber FROM lineitem), f AS (SELECT i, j, k, v FROM p
    QUALIFY row_number() OVER (PARTITION BY i, j, k ORDER BY l_orderkey, l_linenumber, v) = 1)
    SELECT i, j, k, v, i >> 3 AS leaf_i, j >> 3 AS leaf_j, k >> 3 AS leaf_k, i >> 7 AS lower_i, j >> 7 AS lower_j, k >> 7 AS lower_k,
    i >> 12 AS upper_i, j >> 12 AS upper_j, k >> 12 AS upper_k FROM f""")
def from_sparse_first_wins(spark, sf_dir):
    rows = points(spark, sf_dir).select(
        F.floor(F.col("x") / 5).cast("int").alias("i"), F.floor(F.col("y") * 100).cast("int").alias("j"),
        F.floor(F.col("z") * 100).cast("int").alias("k"), "v", "l_orderkey", "l_linenumber",
    )
    return combine.with_tree_keys(combine.first_wins(rows, ["l_orderkey", "l_linenumber", "v"]))


@register("sparse_to_dense", f"""WITH {A_SQL} SELECT CAST(x.i AS INT) AS i, CAST(y.j AS INT) AS j, CAST(z.k AS INT) AS k, coalesce(a.v, CAST(-1 AS FLOAT)) AS v
    FROM range(0, 40) x(i) CROSS JOIN range(0, 50) y(j) CROSS JOIN range(0, 8) z(k) LEFT JOIN a ON a.i = x.i AND a.j = y.j AND a.k = z.k""")
def sparse_to_dense(spark, sf_dir):
    out = combine.sparse_to_dense(box(spark, (40, 50, 8)), lattice(spark, sf_dir, "R"), -1.0)
    return out.withColumn("v", F.col("v").cast("float"))


@register("dense_to_sparse", f"WITH {DENSE_SQL} SELECT i, j, k, v FROM dense WHERE abs(v - 3.0) > 5.0")
def dense_to_sparse(spark, sf_dir):
    return combine.dense_to_sparse(dense(spark, sf_dir), 3.0, 5.0)


@register("active_grid_coords", f"WITH {DENSE_SQL} SELECT i, j, k FROM dense WHERE v <> 3.0")
def active_grid_coords(spark, sf_dir):
    return combine.dense_to_sparse(dense(spark, sf_dir), 3.0).select(*IJK)


@register("prune_grid", f"WITH {DENSE_SQL} SELECT i, j, k, CASE WHEN abs(v - 3.0) <= 5.0 THEN 3.0 ELSE v END AS v FROM dense".replace("THEN 3.0", "THEN CAST(3.0 AS DOUBLE)"))
def prune_grid(spark, sf_dir):
    return combine.prune_grid(dense(spark, sf_dir), 3.0, 5.0)


@register("clip_grid", f"WITH {DENSE_SQL} SELECT i - 1 AS i, j - 2 AS j, k AS k, v FROM dense WHERE i BETWEEN 1 AND 7 AND j BETWEEN 2 AND 8 AND k BETWEEN 0 AND 8")
def clip_grid(spark, sf_dir):
    return combine.clip_grid(dense(spark, sf_dir), DENSE_DIMS, (1.5, 2.0, -4.0), (7.2, 8.5, 99.0))


@register("merge_grids", f"""WITH {DENSE_SQL}, b AS (SELECT i + 4 AS i, j - 3 AS j, k + 1 AS k, v / 3 AS v FROM dense)
    SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, coalesce(a.k, b.k) AS k, CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE least(a.v, b.v) END AS v
    FROM dense a FULL JOIN b ON a.i = b.i AND a.j = b.j AND a.k = b.k""")
def merge_grids(spark, sf_dir):
    d = dense(spark, sf_dir)
    return combine.merge_grids(d, d.withColumn("v", F.col("v") / 3), (4, -3, 1))


@register("fracture", f"""WITH {DENSE_SQL}, c AS (SELECT p.piece, d.i, d.j, d.k, d.v AS inn, CASE p.piece WHEN 0 THEN d.i - 5.0 WHEN 1 THEN 4.0 - d.j ELSE d.k * 1.0 - 2 END AS cut
    FROM dense d CROSS JOIN (VALUES (0), (1), (2)) p(piece))
    SELECT piece, i, j, k, greatest(inn, CAST(cut AS DOUBLE)) AS v FROM c
    UNION ALL SELECT -1, i, j, k, greatest(min(inn), -CAST(min(cut) AS DOUBLE)) FROM c GROUP BY i, j, k""")
def fracture(spark, sf_dir):
    d = dense(spark, sf_dir)
    planes = [F.col("i") - 5.0, 4.0 - F.col("j"), F.col("k") * 1.0 - 2]
    cells = box(spark, DENSE_DIMS)
    cutters = None
    for n, p in enumerate(planes):
        part = cells.select(F.lit(n).alias("piece"), *IJK, p.cast("double").alias("v"))
        cutters = part if cutters is None else cutters.unionByName(part)
    return combine.fracture(d, cutters)


@register("visit_leaves", f"""WITH {A_SQL} SELECT i >> 3 AS li, j >> 3 AS lj, k >> 3 AS lk, count(*) AS n, min(v) AS lo, max(v) AS hi, round(sum(CAST(v AS DOUBLE)), 3) AS total FROM a GROUP BY 1, 2, 3""")
def visit_leaves(spark, sf_dir):
    return combine.visit_leaves(lattice(spark, sf_dir, "R")).withColumn("total", F.round("total", 3))


@register("mask_rank", f"""WITH {A_SQL}, s AS (SELECT i, j, k, ((i & 7) << 6) + ((j & 7) << 3) + (k & 7) AS slot FROM a)
    SELECT i, j, k, slot, CAST(row_number() OVER (PARTITION BY i >> 3, j >> 3, k >> 3 ORDER BY slot) - 1 AS INT) AS rank FROM s""")
def mask_rank(spark, sf_dir):
    return combine.mask_rank(lattice(spark, sf_dir, "R"))


@register("grid_prune_tiles", f"""WITH {VOX_SQL}, {"d AS (SELECT CAST(x.i AS INT) AS i, CAST(y.j AS INT) AS j, CAST(z.k AS INT) AS k, CASE WHEN z.k < 8 AND x.i < 8 THEN 1.0 ELSE x.i * 1.0 END AS v FROM range(0, 16) x(i) CROSS JOIN range(0, 24) y(j) CROSS JOIN range(0, 16) z(k))"},
    n AS (SELECT i >> 3 AS li, j >> 3 AS lj, k >> 3 AS lk, count(*) AS c, min(v) AS lo, max(v) AS hi FROM d GROUP BY 1, 2, 3 HAVING count(*) = 512 AND min(v) = max(v))
    SELECT li << 3 AS i, lj << 3 AS j, lk << 3 AS k, CAST(lo AS DOUBLE) AS v, 1 AS level FROM n UNION ALL
    SELECT i, j, k, CAST(v AS DOUBLE), 0 FROM d ANTI JOIN n ON i >> 3 = li AND j >> 3 = lj AND k >> 3 = lk""".replace(f"WITH {VOX_SQL}, d AS", "WITH d AS"))
def grid_prune_tiles(spark, sf_dir):
    d = box(spark, (16, 24, 16)).withColumn("v", F.when((F.col("k") < 8) & (F.col("i") < 8), 1.0).otherwise(F.col("i").cast("double")))
    return combine.prune_tiles(d)
