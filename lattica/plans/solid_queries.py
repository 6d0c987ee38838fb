"""Queries over meshes, the Poisson equation, gradient companions and splats."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import functions as F

from ..model import A_SQL, B_SQL, CUBE, DENSE_DIMS, DENSE_SQL, FACES, IJK, dense, lattice, offsets_sql, table
from ..operators import gradients, mesh, pde, splats
from .field_queries import _KERNEL, _KERNEL_SQL, _rounded
from .registry import register
from .shape_queries import _JOIN, _LIN, _part_points, _POINTS, _tap_sql


def _soup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key, bal = F.col("s_suppkey").cast("double"), F.col("s_acctbal").cast("double")
    a = [key % 11, bal / 1000, key % 9]
    b, c = [a[0] + 1.1, a[1] + 0.2, a[2]], [a[0], a[1] + 1.3, a[2] + 0.3]
    return s.select(F.col("s_suppkey").alias("fid"), *(x.alias(f"{n}{d}") for n, p in zip("abc", (a, b, c), strict=True) for x, d in zip(p, "xyz", strict=True)))


_SOUP = """soup AS (SELECT s_suppkey AS fid, k % 11 AS ax, b / 1000 AS ay, k % 9 AS az, k % 11 + CAST(1.1 AS DOUBLE) AS bx, b / 1000 + CAST(0.2 AS DOUBLE) AS by_, k % 9 AS bz,
    k % 11 AS cx, b / 1000 + CAST(1.3 AS DOUBLE) AS cy, k % 9 + CAST(0.3 AS DOUBLE) AS cz FROM (SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) AS k, CAST(s_acctbal AS DOUBLE) AS b FROM supplier)),
    n AS (SELECT *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM soup)"""


@register("triangle_areas", f"WITH {_SOUP} SELECT fid, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 6) AS area FROM n")
def triangle_areas(spark, sf_dir):
    return _rounded(mesh.triangle_areas(_soup(spark, sf_dir)), "area")


@register("mesh_summary", f"""WITH {_SOUP} SELECT count(*) AS faces, round(sum(sqrt(nx * nx + ny * ny + nz * nz) / 2), 4) AS area,
    round(sum(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx)) / 6, 4) + 0.0 AS volume FROM n""")
def mesh_summary(spark, sf_dir):
    return _rounded(mesh.mesh_summary(_soup(spark, sf_dir)), "area", "volume", places=4)


def _faces(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("fid"), (key % 97).alias("v0"), ((key * 7 + 1) % 89 + 97).alias("v1"), ((key * 3 + 2) % 101 + 200).alias("v2"))


_EDGES = """f AS (SELECT p_partkey % 97 AS v0, (p_partkey * 7 + 1) % 89 + 97 AS v1, (p_partkey * 3 + 2) % 101 + 200 AS v2 FROM part),
    d AS (SELECT v0 AS p, v1 AS q FROM f UNION ALL SELECT v1, v2 FROM f UNION ALL SELECT v2, v0 FROM f),
    u AS (SELECT least(p, q) AS p, greatest(p, q) AS q, count(*) AS uses, count(*) FILTER (p < q) AS ahead FROM d GROUP BY 1, 2)"""


@register("edge_uses", f"WITH {_EDGES} SELECT p, q, uses, ahead FROM u")
def edge_uses(spark, sf_dir):
    return mesh.edge_uses(_faces(spark, sf_dir))


@register("manifold_report", f"WITH {_EDGES} SELECT count(*) AS edges, count(*) FILTER (uses = 1) AS open, count(*) FILTER (uses > 2) AS crowded, count(*) FILTER (uses = 2 AND ahead <> 1) AS turned FROM u")
def manifold_report(spark, sf_dir):
    return mesh.manifold_report(_faces(spark, sf_dir))


def _edge_sql(s, t):
    names = {"a": ("ax", "ay", "az"), "b": ("bx", "by_", "bz"), "c": ("cx", "cy", "cz")}
    p, q = names[s], names[t]
    h = f"least(greatest((({' + '.join(f'({x} - {a}) * ({b} - {a})' for x, a, b in zip('xyz', p, q, strict=True))}) / ({' + '.join(f'({b} - {a}) * ({b} - {a})' for a, b in zip(p, q, strict=True))})), 0), 1)"
    return " + ".join(f"({x} - {a} - {h} * ({b} - {a})) * ({x} - {a} - {h} * ({b} - {a}))" for x, a, b in zip("xyz", p, q, strict=True))


def _side_sql(s, t):
    names = {"a": ("ax", "ay", "az"), "b": ("bx", "by_", "bz"), "c": ("cx", "cy", "cz")}
    (px, py, pz), (qx, qy, qz) = names[s], names[t]
    return f"""(((({qy} - {py}) * (z - {pz}) - ({qz} - {pz}) * (y - {py})) * nx + (({qz} - {pz}) * (x - {px}) - ({qx} - {px}) * (z - {pz})) * ny
        + (({qx} - {px}) * (y - {py}) - ({qy} - {py}) * (x - {px})) * nz) >= 0)"""


@register("closest_triangle", f"""WITH {_SOUP}, {_POINTS}, d AS (SELECT p_partkey, fid, sqrt(CASE WHEN {_side_sql("a", "b")} AND {_side_sql("b", "c")} AND {_side_sql("c", "a")}
    THEN ((x - ax) * nx + (y - ay) * ny + (z - az) * nz) * ((x - ax) * nx + (y - ay) * ny + (z - az) * nz) / (nx * nx + ny * ny + nz * nz)
    ELSE least({_edge_sql("a", "b")}, {_edge_sql("b", "c")}, {_edge_sql("c", "a")}) END) AS d FROM pts CROSS JOIN n)
    SELECT p_partkey, fid, round(d, 6) + 0.0 AS distance FROM d WHERE d <= 1.5 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY d, fid) = 1""")
def closest_triangle(spark, sf_dir):
    return _rounded(mesh.closest_triangle(_part_points(spark, sf_dir), "p_partkey", _soup(spark, sf_dir), 1.5), "distance")


_TIPS = [(5.0 + 3 * a, 4.0 + 3 * b, 3.0 + 3 * c) for a, b, c in FACES]


def _octahedron(spark):
    rows = []
    for n, (sx, sy, sz) in enumerate(product((0, 1), repeat=3)):
        a, b, c = _TIPS[sx], _TIPS[2 + sy], _TIPS[4 + sz]
        if (sx + sy + sz) % 2 == 0:
            b, c = c, b
        rows.append((n, *a, *b, *c))
    return spark.createDataFrame(rows, "fid int, " + ", ".join(f"{p}{x} double" for p in "abc" for x in "xyz"))


_PARTS_OF = {"a": ("ax", "ay", "az"), "b": ("bx", "by_", "bz"), "c": ("cx", "cy", "cz")}


def _winding_sql(points, key):
    """wn(key, winding) of the points x, y, z against the octahedron."""
    faces = ", ".join("(" + ", ".join(f"CAST({c} AS DOUBLE)" for c in row) + ")" for row in _octahedron_rows())
    near = {p: [f"({a} - {x})" for a, x in zip(names, "xyz", strict=True)] for p, names in _PARTS_OF.items()}
    dot = lambda p, q: "(" + " + ".join(f"{m} * {n}" for m, n in zip(near[p], near[q], strict=True)) + ")"
    (x1, y1, z1), (x2, y2, z2), (x3, y3, z3) = near.values()
    det = f"({x1} * ({y2} * {z3} - {z2} * {y3}) + {y1} * ({z2} * {x3} - {x2} * {z3}) + {z1} * ({x2} * {y3} - {y2} * {x3}))"
    size = {p: f"sqrt({dot(p, p)})" for p in near}
    low = f"({size['a']} * {size['b']} * {size['c']} + {dot('a', 'b')} * {size['c']} + {dot('b', 'c')} * {size['a']} + {dot('c', 'a')} * {size['b']})"
    return f"""oct(ax, ay, az, bx, by_, bz, cx, cy, cz) AS (VALUES {faces}), wn AS (SELECT {key}, sum(2 * atan2({det}, {low})) / (4 * pi()) AS winding FROM {points} CROSS JOIN oct GROUP BY ALL)"""


def _octahedron_rows():
    out = []
    for sx, sy, sz in product((0, 1), repeat=3):
        turned = [_TIPS[2 + sy], _TIPS[4 + sz]] if (sx + sy + sz) % 2 else [_TIPS[4 + sz], _TIPS[2 + sy]]
        out.append((*_TIPS[sx], *turned[0], *turned[1]))
    return out


@register("winding", f"WITH {_POINTS}, {_winding_sql('pts', 'p_partkey')} SELECT p_partkey, round(winding, 6) + 0.0 AS winding FROM wn")
def winding(spark, sf_dir):
    return _rounded(mesh.winding(_part_points(spark, sf_dir), "p_partkey", _octahedron(spark)), "winding")


_SIDES = " AND ".join(_side_sql(p, q) for p, q in ("ab", "bc", "ca"))
_FLAT = "((x - ax) * nx + (y - ay) * ny + (z - az) * nz)"


@register("mesh_to_sdf", f"""WITH {DENSE_SQL}, mid AS (SELECT i, j, k, i + CAST(0.5 AS DOUBLE) AS x, j + CAST(0.5 AS DOUBLE) AS y, k + CAST(0.5 AS DOUBLE) AS z FROM dense), {_winding_sql("mid", "i, j, k")},
    nn AS (SELECT *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM oct),
    ds AS (SELECT i, j, k, min(sqrt(CASE WHEN {_SIDES} THEN {_FLAT} * {_FLAT} / (nx * nx + ny * ny + nz * nz) ELSE least({_edge_sql("a", "b")}, {_edge_sql("b", "c")}, {_edge_sql("c", "a")}) END)) AS d
        FROM mid CROSS JOIN nn GROUP BY ALL)
    SELECT i, j, k, round(CASE WHEN winding >= 0.5 THEN -1 ELSE 1 END * least(d, 2.0), 6) + 0.0 AS v FROM ds JOIN wn USING (i, j, k)""")
def mesh_to_sdf(spark, sf_dir):
    return _rounded(mesh.mesh_to_sdf(dense(spark, sf_dir), _octahedron(spark), 2.0), "v")


@register("mesh_to_level_set", f"""WITH mid AS (SELECT CAST(a.i AS INT) AS i, CAST(b.j AS INT) AS j, CAST(c.k AS INT) AS k, a.i * CAST(0.5 AS DOUBLE) AS x, b.j * CAST(0.5 AS DOUBLE) AS y, c.k * CAST(0.5 AS DOUBLE) AS z
        FROM range(-2, 24) a(i) CROSS JOIN range(-4, 22) b(j) CROSS JOIN range(-6, 20) c(k)), {_winding_sql("mid", "i, j, k")},
    nn AS (SELECT *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM oct),
    ds AS (SELECT i, j, k, min(sqrt(CASE WHEN {_SIDES} THEN {_FLAT} * {_FLAT} / (nx * nx + ny * ny + nz * nz) ELSE least({_edge_sql("a", "b")}, {_edge_sql("b", "c")}, {_edge_sql("c", "a")}) END)) AS d
        FROM mid CROSS JOIN nn GROUP BY ALL), sd AS (SELECT i, j, k, CASE WHEN abs(winding) > 0.5 THEN -d ELSE d END AS v FROM ds JOIN wn USING (i, j, k))
    SELECT i, j, k, round(v, 6) + 0.0 AS v FROM sd WHERE v > -0.917 AND v < 1.213""")
def mesh_to_level_set(spark, sf_dir):
    return _rounded(mesh.mesh_to_level_set(_octahedron(spark), 0.5, 1.213, 0.917), "v")


@register("level_set_rebuild")
def level_set_rebuild(spark, sf_dir):
    return _rounded(mesh.level_set_rebuild(dense(spark, sf_dir), 1.5, 1.5, 0.5), "v")


_CASES = f"""WITH {DENSE_SQL}, x AS (SELECT t.i, t.j, t.k, CAST(sum(CASE WHEN s.v < 0 THEN 1 << (a + 2 * b + 4 * c) ELSE 0 END) AS INT) AS "case"
    FROM dense t CROSS JOIN (VALUES (0), (1)) p(a) CROSS JOIN (VALUES (0), (1)) q(b) CROSS JOIN (VALUES (0), (1)) r(c)
    JOIN dense s ON s.i = t.i + a AND s.j = t.j + b AND s.k = t.k + c WHERE t.i < 10 AND t.j < 10 AND t.k < 8 GROUP BY 1, 2, 3)"""


@register("marching_cases", f'{_CASES} SELECT i, j, k, "case" FROM x')
def marching_cases(spark, sf_dir):
    return mesh.marching_cases(dense(spark, sf_dir), DENSE_DIMS)


@register("surface_cubes", f'{_CASES} SELECT "case", count(*) AS n FROM x WHERE "case" BETWEEN 1 AND 254 GROUP BY 1')
def surface_cubes(spark, sf_dir):
    return mesh.surface_cubes(dense(spark, sf_dir), DENSE_DIMS)


@register("crossing_vertices", f"""WITH {DENSE_SQL}, o(axis, di, dj, dk) AS (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1)), m AS (SELECT t.i, t.j, t.k, axis, di, dj, dk, (0 - t.v) / (s.v - t.v) AS h FROM dense t CROSS JOIN o
    JOIN dense s ON s.i = t.i + di AND s.j = t.j + dj AND s.k = t.k + dk WHERE (t.v < 0) <> (s.v < 0))
    SELECT i, j, k, axis, round(i + 0.5 + di * h, 6) AS x, round(j + 0.5 + dj * h, 6) AS y, round(k + 0.5 + dk * h, 6) AS z FROM m""")
def crossing_vertices(spark, sf_dir):
    return _rounded(mesh.crossing_vertices(dense(spark, sf_dir), DENSE_DIMS), "x", "y", "z")


@register("surface_triangles")
def surface_triangles(spark, sf_dir):
    return _rounded(mesh.surface_triangles(dense(spark, sf_dir), DENSE_DIMS), *(f"{p}{x}" for p in "abc" for x in "xyz"))


_TETS = ", ".join(f"({n}, {sum(1 << c for c in t)})" for n, t in enumerate(mesh.KUHN))


@register("interior_tets", f'{_CASES} SELECT i, j, k, tet FROM x CROSS JOIN (VALUES {_TETS}) t(tet, mask) WHERE "case" & mask = mask')
def interior_tets(spark, sf_dir):
    return mesh.interior_tets(dense(spark, sf_dir), DENSE_DIMS)


def _tetrahedra(spark, sf_dir):
    s = _soup(spark, sf_dir)
    return s.withColumnRenamed("fid", "tid").withColumns({"dx": F.col("ax") + 0.4, "dy": F.col("ay") + 0.3, "dz": F.col("az") + 1.2})


@register("tet_quality", f"""WITH {_SOUP}, t AS (SELECT fid AS tid, (0.4 * nx + 0.3 * ny + 1.2 * nz) / 6 AS volume FROM n) SELECT tid, round(volume, 6) AS volume FROM t""")
def tet_quality(spark, sf_dir):
    return _rounded(mesh.tet_quality(_tetrahedra(spark, sf_dir)).select("tid", "volume"), "volume")


def _dihedral_sql():
    """The angles between the faces of a tetrahedron (p0 to p3), a text for each edge."""
    point = lambda n, x: f"p{n}{x}"
    out = []
    for a, b in combinations(range(4), 2):
        c, d = (n for n in range(4) if n not in (a, b))
        e = [f"({point(b, x)} - {point(a, x)})" for x in "xyz"]
        sides = []
        for o in (c, d):
            w = [f"({point(o, x)} - {point(a, x)})" for x in "xyz"]
            sides.append([f"({e[(n + 1) % 3]} * {w[(n + 2) % 3]} - {e[(n + 2) % 3]} * {w[(n + 1) % 3]})" for n in range(3)])
        dot = lambda p, q: "(" + " + ".join(f"{m} * {n}" for m, n in zip(p, q, strict=True)) + ")"
        out.append(f"degrees(acos(least(greatest({dot(*sides)} / sqrt({dot(sides[0], sides[0])} * {dot(sides[1], sides[1])}), -1), 1)))")
    return out


_TETS4 = f"""t AS (SELECT ax AS p0x, ay AS p0y, az AS p0z, bx AS p1x, by_ AS p1y, bz AS p1z, cx AS p2x, cy AS p2y, cz AS p2z, ax + CAST(0.4 AS DOUBLE) AS p3x, ay + CAST(0.3 AS DOUBLE) AS p3y, az + CAST(1.2 AS DOUBLE) AS p3z,
    (0.4 * nx + 0.3 * ny + 1.2 * nz) / 6 AS volume FROM n)"""


@register("tet_mesh_quality", f"""WITH {_SOUP}, {_TETS4}, q AS (SELECT volume, least({", ".join(_dihedral_sql())}) AS least, greatest({", ".join(_dihedral_sql())}) AS largest FROM t)
    SELECT round(min("least"), 4) AS "least", round(max(largest), 4) AS largest, round(sum(volume), 4) AS volume, count(*) FILTER (volume <= 0) AS inverted, count(*) AS tets FROM q""")
def tet_mesh_quality(spark, sf_dir):
    return _rounded(mesh.tet_mesh_quality(_tetrahedra(spark, sf_dir)), "least", "largest", "volume", places=4)


@register("solve_poisson")
def solve_poisson(spark, sf_dir):
    return _rounded(pde.solve_poisson(dense(spark, sf_dir), 1.0, 1e-6, 60), "u", places=3)


_GRADS = "gr AS (SELECT i, j, k, CAST(v AS DOUBLE) / 1000 * CAST(0.9731377 AS DOUBLE) AS g FROM a)"


def _grads(spark, sf_dir):
    return lattice(spark, sf_dir, "R").select(*IJK, (F.col("v").cast("double") / 1000 * 0.9731377).alias("g"))


@register("conv3d_vjp_values", f"""WITH {A_SQL}, {_KERNEL_SQL}, {_GRADS} SELECT t.i, t.j, t.k, round(coalesce(sum(w.w * gr.g), 0), 5) + 0.0 AS v FROM a t CROSS JOIN w
    LEFT JOIN gr ON gr.i = t.i - di AND gr.j = t.j - dj AND gr.k = t.k - dk GROUP BY 1, 2, 3""")
def conv3d_vjp_values(spark, sf_dir):
    return _rounded(gradients.conv3d_vjp_values(_grads(spark, sf_dir), _KERNEL, lattice(spark, sf_dir, "R")), "v", places=5)


@register("conv3d_vjp_kernel", f"""WITH {A_SQL}, {offsets_sql(CUBE)}, {_GRADS} SELECT di, dj, dk, round(sum(gr.g * coalesce(CAST(s.v AS DOUBLE), 100.0)) / 1000, 3) + 0.0 AS w FROM gr CROSS JOIN o
    LEFT JOIN a s ON s.i = gr.i + di AND s.j = gr.j + dj AND s.k = gr.k + dk GROUP BY 1, 2, 3""")
def conv3d_vjp_kernel(spark, sf_dir):
    made = gradients.conv3d_vjp_kernel(_grads(spark, sf_dir), lattice(spark, sf_dir, "R"), CUBE, 100.0)
    return _rounded(made.withColumn("w", F.col("w") / 1000), "w", places=3)


@register("sample_vjp_grid", f"""{_tap_sql(_LIN, (0, 1))} SELECT least(greatest(ri, 0), 10) AS i, least(greatest(rj, 0), 10) AS j, least(greatest(rk, 0), 8) AS k,
    round(sum(w * (p_partkey % 100) / 10.27642), 5) + 0.0 AS v FROM t GROUP BY 1, 2, 3""")
def sample_vjp_grid(spark, sf_dir):
    points = _part_points(spark, sf_dir).withColumn("g", (F.col("p_partkey") % 100) / 10.27642)
    return _rounded(gradients.sample_vjp_grid(points, DENSE_DIMS), "v", places=5)


for _op, _a_wins, _b_wins, _sign in (("union", "a.v < b.v", "b.v < a.v", ""), ("intersection", "a.v > b.v", "b.v > a.v", ""), ("difference", "a.v > -b.v", "-b.v > a.v", "-")):
    _sql = f"""WITH {A_SQL}, {B_SQL}, {_GRADS}
        SELECT a.i, a.j, a.k, CASE WHEN {_a_wins} THEN g WHEN {_b_wins} THEN 0 ELSE 0.5 * g END + 0.0 AS ga, CASE WHEN {_a_wins} THEN 0 WHEN {_b_wins} THEN {_sign}g ELSE {_sign}0.5 * g END + 0.0 AS gb
        FROM a JOIN b ON a.i = b.i AND a.j = b.j AND a.k = b.k JOIN gr ON gr.i = a.i AND gr.j = a.j AND gr.k = a.k"""
    register(f"csg_{_op}_vjp", _sql)(lambda spark, sf_dir, op=_op: _csg_grads(spark, sf_dir, op))


def _csg_grads(spark, sf_dir, op):
    f = {"union": gradients.csg_union_vjp, "intersection": gradients.csg_intersection_vjp, "difference": gradients.csg_difference_vjp}[op]
    made = f(lattice(spark, sf_dir, "R"), lattice(spark, sf_dir, "A"), _grads(spark, sf_dir))
    return made.select(*IJK, (F.col("ga") + 0.0).alias("ga"), (F.col("gb") + 0.0).alias("gb"))


def _slope_sql(axis):
    return " * ".join(f"(CASE s{c} WHEN 0 THEN -1 ELSE 1 END)" if c == axis else f"({_LIN.format(c)})" for c in IJK)


@register("sample_vjp_points", f"""{_tap_sql(_LIN, (0, 1))} SELECT p_partkey, {", ".join(f"round(sum({_slope_sql(c)} * d.v * (p_partkey % 100) / 10.27642), 5) + 0.0 AS g{x}" for c, x in zip(IJK, "xyz", strict=True))}
    FROM t {_JOIN} GROUP BY 1""")
def sample_vjp_points(spark, sf_dir):
    points = _part_points(spark, sf_dir).withColumn("g", (F.col("p_partkey") % 100) / 10.27642)
    return _rounded(gradients.sample_vjp_points(points, "p_partkey", dense(spark, sf_dir), DENSE_DIMS), "gx", "gy", "gz", places=5)


@register("splat_vjp_values", f"{_tap_sql(_LIN, (0, 1))} SELECT p_partkey, round(sum(w * (d.v * 0.317 + d.i)), 6) + 0.0 AS g FROM t {_JOIN} GROUP BY 1")
def splat_vjp_values(spark, sf_dir):
    grads = dense(spark, sf_dir).select(*IJK, (F.col("v") * 0.317 + F.col("i")).alias("g"))
    return _rounded(gradients.splat_vjp_values(_part_points(spark, sf_dir), "p_partkey", grads, DENSE_DIMS), "g")


@register("max_pool_vjp", f"""WITH {DENSE_SQL}, b AS (SELECT i, j, k, row_number() OVER (PARTITION BY i // 2, j // 3, k // 2 ORDER BY v DESC, k, j, i) AS r FROM dense)
    SELECT i, j, k, CAST(i // 2 + 10 * (j // 3) + 100 * (k // 2) AS DOUBLE) AS v FROM b WHERE r = 1""")
def max_pool_vjp(spark, sf_dir):
    from ..operators.stats import pool

    blocks = pool(dense(spark, sf_dir), (2, 3, 2), "max")
    grads = blocks.select(*IJK, (F.col("i") + 10 * F.col("j") + 100 * F.col("k")).cast("double").alias("g"))
    return gradients.max_pool_vjp(dense(spark, sf_dir), (2, 3, 2), grads)


def _sh_sql(degree):
    """Terms of the sum as text: factor, polynomial of the unit direction."""
    c1, c2, c3 = splats.SH1, splats.SH2, splats.SH3
    terms = [
        (splats.SH0, "1"), (-c1, "y"), (c1, "z"), (-c1, "x"),
        (c2[0], "x*y"), (c2[1], "y*z"), (c2[2], "(2*z*z - x*x - y*y)"), (c2[3], "x*z"), (c2[4], "(x*x - y*y)"),
        (c3[0], "y*(3*x*x - y*y)"), (c3[1], "x*y*z"), (c3[2], "y*(4*z*z - x*x - y*y)"), (c3[3], "z*(2*z*z - 3*x*x - 3*y*y)"),
        (c3[4], "x*(4*z*z - x*x - y*y)"), (c3[5], "z*(x*x - y*y)"), (c3[6], "x*(x*x - 3*y*y)"),
    ][: (degree + 1) ** 2]
    total = lambda c: " + ".join(f"CAST({f!r} AS DOUBLE) * {p} * CAST(embedding[{3 * n + c + 1}] AS DOUBLE)" for n, (f, p) in enumerate(terms))
    return f"""d AS (SELECT vec_id, embedding, CAST(embedding[51] AS DOUBLE) AS a, CAST(embedding[52] AS DOUBLE) AS b, CAST(embedding[53] AS DOUBLE) AS c FROM embeddings),
        u AS (SELECT *, a / sqrt(a*a + b*b + c*c) AS x, b / sqrt(a*a + b*b + c*c) AS y, c / sqrt(a*a + b*b + c*c) AS z FROM d),
        sh AS (SELECT vec_id, """ + ", ".join(f"greatest({total(n)} + 0.5, 0) AS {c}" for n, c in enumerate("rgb")) + " FROM u)"


def _directed(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sid"), "vec_id", "embedding", *(F.col("embedding")[50 + n].alias(f"d{c}") for n, c in enumerate("xyz")))


for _degree in range(4):
    _sql = f"WITH {_sh_sql(_degree)} SELECT vec_id, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM sh"
    register(f"splat_sh_eval_{_degree}", _sql)(
        lambda spark, sf_dir, degree=_degree: _rounded(splats.sh_eval(_directed(spark, sf_dir), "vec_id", "embedding", ("dx", "dy", "dz"), degree), "r", "g", "b")
    )


def _splats(spark, sf_dir):
    e = lambda n: F.col("embedding")[n].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sid"), (e(0) * 2).alias("x"), (e(1) * 2).alias("y"), (F.abs(e(2)) * 5 + 2).alias("z"), e(3).alias("qx"), e(4).alias("qy"),
        e(5).alias("qz"), F.sqrt(1 - e(3) * e(3) - e(4) * e(4) - e(5) * e(5)).alias("qw"), (e(7) - 2).alias("sx"), (e(8) - 2).alias("sy"), (e(9) - 2).alias("sz"),
        e(10).alias("logit"),
    )


_CAMERA = splats.perspective(40.0, 40.0, 16.0, 16.0)
_E = "CAST(embedding[{}] AS DOUBLE)".format
_TURN = {"r00": "1 - 2*(y*y + z*z)", "r01": "2*(x*y - w*z)", "r02": "2*(x*z + w*y)", "r10": "2*(x*y + w*z)", "r11": "1 - 2*(x*x + z*z)", "r12": "2*(y*z - w*x)", "r20": "2*(x*z - w*y)", "r21": "2*(y*z + w*x)", "r22": "1 - 2*(x*x + y*y)"}
_TURNED = f"""q AS (SELECT vec_id AS sid, embedding, {_E(1)} * 2 AS mx, {_E(2)} * 2 AS my, abs({_E(3)}) * 5 + 2 AS mz, {_E(4)} AS x, {_E(5)} AS y, {_E(6)} AS z,
    sqrt(1 - {_E(4)} * {_E(4)} - {_E(5)} * {_E(5)} - {_E(6)} * {_E(6)}) AS w, {_E(8)} - 2 AS sx, {_E(9)} - 2 AS sy, {_E(10)} - 2 AS sz, {_E(11)} AS logit FROM embeddings),
    r AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _TURN.items())} FROM q)"""


def _cov_sql(p, q):
    return f"(r{p}0 * r{q}0 * vx + r{p}1 * r{q}1 * vy + r{p}2 * r{q}2 * vz) AS s{p}{q}"


_PROJECT = f"""{_TURNED}, sc AS (SELECT *, pow(2.0, 2 * sx) AS vx, pow(2.0, 2 * sy) AS vy, pow(2.0, 2 * sz) AS vz FROM r),
    cv AS (SELECT *, {", ".join(_cov_sql(p, q) for p in range(3) for q in range(p, 3))}, 40 / mz AS jx, -40 * mx / (mz * mz) AS jp, -40 * my / (mz * mz) AS jq FROM sc WHERE mz > 0.01),
    fl AS (SELECT *, jx*jx*s00 + 2*jx*jp*s02 + jp*jp*s22 + 0.3 AS fa, jx*jx*s01 + jx*jq*s02 + jp*jx*s12 + jp*jq*s22 AS fb, jx*jx*s11 + 2*jx*jq*s12 + jq*jq*s22 + 0.3 AS fc FROM cv),
    pr AS (SELECT sid, 40 * mx / mz + 16 AS u, 40 * my / mz + 16 AS v, mz AS depth, fc / (fa*fc - fb*fb) AS ca, -fb / (fa*fc - fb*fb) AS cb, fa / (fa*fc - fb*fb) AS cc,
        3 * sqrt((fa + fc) / 2 + sqrt((fa - fc) * (fa - fc) + 4*fb*fb) / 2) AS radius, 1 / (1 + exp(-logit)) AS opacity FROM fl)"""
_PROJECTED = ("u", "v", "depth", "ca", "cb", "cc", "radius", "opacity")


@register("splat_project", f"WITH {_PROJECT} SELECT sid, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _PROJECTED)} FROM pr")
def splat_project(spark, sf_dir):
    return _rounded(splats.project(_splats(spark, sf_dir), _CAMERA), *_PROJECTED)


def _seen(spark, sf_dir):
    return splats.project(_splats(spark, sf_dir), _CAMERA), splats.sh_eval(_directed(spark, sf_dir), "sid", "embedding", ("dx", "dy", "dz"), 3)


_BLEND = f"""{_PROJECT}, {_sh_sql(3)}, px AS (SELECT CAST(a.x AS INT) AS px, CAST(b.y AS INT) AS py FROM range(0, 32) a(x) CROSS JOIN range(0, 32) b(y)),
    al AS (SELECT pr.*, px, py, px - u AS dx, py - v AS dy, greatest(0.5 * (ca * (px - u) * (px - u) + cc * (py - v) * (py - v)) + cb * (px - u) * (py - v), 0) AS power
        FROM pr JOIN px ON px // 16 BETWEEN floor((u - radius) / 16) AND floor((u + radius) / 16) AND py // 16 BETWEEN floor((v - radius) / 16) AND floor((v + radius) / 16)),
    av AS (SELECT al.*, opacity * exp(-power) AS alpha, r, g, b FROM al JOIN sh ON sh.vec_id = al.sid WHERE power <= 10 AND opacity * exp(-power) >= 0.005),
    bf AS (SELECT *, coalesce(product(1 - alpha) OVER (PARTITION BY px, py ORDER BY depth, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM av),
    us AS (SELECT * FROM bf WHERE before >= 0.001)"""


@register("splat_raster", f"""WITH {_BLEND}, im AS (SELECT px, py, sum(before * alpha * r) AS r, sum(before * alpha * g) AS g, sum(before * alpha * b) AS b, product(1 - alpha) AS t FROM us GROUP BY 1, 2)
    SELECT px.px, px.py, round(coalesce(r, 0) + coalesce(t, 1) * 0.1, 6) AS r, round(coalesce(g, 0) + coalesce(t, 1) * 0.2, 6) AS g, round(coalesce(b, 0) + coalesce(t, 1) * 0.3, 6) AS b, round(coalesce(t, 1), 6) AS through
    FROM px LEFT JOIN im ON im.px = px.px AND im.py = px.py""")
def splat_raster(spark, sf_dir):
    return _rounded(splats.rasterize(*_seen(spark, sf_dir), 32, 32, background=(0.1, 0.2, 0.3)), "r", "g", "b", "through")


_ASKED = "px, py, (px % 5) / 7.3 AS gr, (py % 3) / 5.1 AS gg, (px + py) % 4 / 6.7 AS gb, px / 41.3 AS ga"


@register("splat_raster_vjp", f"""WITH {_BLEND}, gi AS (SELECT {_ASKED} FROM px),
    ak AS (SELECT us.*, gr, gg, gb, ga, r * gr + g * gg + b * gb AS shown, 0.1 * gr + 0.2 * gg + 0.3 * gb AS back FROM us JOIN gi ON gi.px = us.px AND gi.py = us.py),
    en AS (SELECT *, product(1 - alpha) OVER (PARTITION BY px, py) AS t,
        coalesce(sum(before * alpha * shown) OVER (PARTITION BY px, py ORDER BY depth DESC, sid DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM ak),
    da AS (SELECT *, before * shown - (later + t * (back - ga)) / (1 - alpha) AS da FROM en)
    SELECT sid, round(sum(alpha * da * (ca * dx + cb * dy)), 4) + 0.0 AS gu, round(sum(alpha * da * (cb * dx + cc * dy)), 4) + 0.0 AS gv, round(sum(-alpha * da * dx * dx / 2), 4) + 0.0 AS gca,
        round(sum(-alpha * da * dx * dy), 4) + 0.0 AS gcb, round(sum(-alpha * da * dy * dy / 2), 4) + 0.0 AS gcc, round(sum(da * alpha / opacity), 4) + 0.0 AS gopacity,
        round(sum(before * alpha * gr), 4) + 0.0 AS gr, round(sum(before * alpha * gg), 4) + 0.0 AS gg, round(sum(before * alpha * gb), 4) + 0.0 AS gb FROM da GROUP BY 1""")
def splat_raster_vjp(spark, sf_dir):
    n = F.col("id")
    grads = spark.range(1024).select((n % 32).cast("int").alias("px"), F.floor(n / 32).cast("int").alias("py"))
    grads = grads.select("px", "py", (F.col("px") % 5 / 7.3).alias("gr"), (F.col("py") % 3 / 5.1).alias("gg"), ((F.col("px") + F.col("py")) % 4 / 6.7).alias("gb"), (F.col("px") / 41.3).alias("ga"))
    made = splats.rasterize_vjp(*_seen(spark, sf_dir), grads, 32, 32, background=(0.1, 0.2, 0.3))
    return _rounded(made, *(c for c in made.columns if c != "sid"), places=4)


@register("splat_relocate", f"""WITH p AS (SELECT vec_id AS sid, CAST(vec_id % 7 + 1 AS INT) AS n, 1 / (1 + exp(-{_E(11)})) AS o, exp({_E(8)}) AS sx, exp({_E(9)}) AS sy, exp({_E(10)}) AS sz FROM embeddings),
    w AS (SELECT *, 1 - pow(1 - o, 1.0 / n) AS p FROM p),
    d AS (SELECT sid, sum(CAST(factorial(CAST(i - 1 AS INT)) / (factorial(CAST(k AS INT)) * factorial(CAST(i - 1 - k AS INT))) AS DOUBLE) * CASE k % 2 WHEN 0 THEN 1 ELSE -1 END / sqrt(k + 1) * pow(p, k + 1)) AS d
        FROM w JOIN range(1, 8) a(i) ON i <= n JOIN range(0, 7) b(k) ON k < i GROUP BY 1)
    SELECT sid, round(p, 6) AS opacity, round(o / d * sx, 6) AS sx, round(o / d * sy, 6) AS sy, round(o / d * sz, 6) AS sz FROM w JOIN d USING (sid)""")
def splat_relocate(spark, sf_dir):
    s = _splats(spark, sf_dir)
    plain = s.select("sid", (F.col("sid") % 7 + 1).alias("ratio"), (1 / (1 + F.exp(-F.col("logit")))).alias("opacity"), *(F.exp(F.col(c) + 2).alias(c) for c in ("sx", "sy", "sz")))
    return _rounded(splats.relocate(plain), "opacity", "sx", "sy", "sz")


@register("splat_add_noise", f"""WITH {_TURNED}, v AS (SELECT *, exp(2 * sx) AS vx, exp(2 * sy) AS vy, exp(2 * sz) AS vz, 500 / (1 + exp(-100 * (0.005 - 1 / (1 + exp(8 - logit))))) AS gate FROM r),
    c AS (SELECT *, {", ".join(_cov_sql(p, q) for p in range(3) for q in range(p, 3))}, {_E(21)} * gate AS gx, {_E(22)} * gate AS gy, {_E(23)} * gate AS gz FROM v)
    SELECT sid, round(mx + s00*gx + s01*gy + s02*gz, 5) + 0.0 AS x, round(my + s01*gx + s11*gy + s12*gz, 5) + 0.0 AS y, round(mz + s02*gx + s12*gy + s22*gz, 5) + 0.0 AS z FROM c""")
def splat_add_noise(spark, sf_dir):
    noise = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sid"), *(F.col("embedding")[20 + n].cast("double").alias(f"n{c}") for n, c in enumerate("xyz")))
    s = _splats(spark, sf_dir).withColumn("logit", F.col("logit") - 8).join(noise, "sid")
    return _rounded(splats.add_noise(s, 500.0), "x", "y", "z", places=5)
