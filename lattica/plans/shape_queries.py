"""Queries over level sets, topology, sampling, rays and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import A_SQL, CUBE, DENSE_DIMS, DENSE_SQL, FACES, IJK, NEAR26, dense, lattice, offsets_sql, table
from ..operators import levelset, sampling
from .field_queries import _rounded
from .registry import register

_SIZE, _BAND, _CENTER = 0.25, 0.75, (0.1, -0.2, 0.3)


def _field_sql(low, high, body, size=_SIZE, band=_BAND, extra=""):
    """The lattice of a generator with its clamped value."""
    nx, ny, nz = levelset.lattice_dims(low, high, size)
    p = ", ".join(f"CAST({a - size / 2!r} AS DOUBLE) + ({c} + 0.5) * CAST({size!r} AS DOUBLE) AS {x}" for a, c, x in zip(low, IJK, "xyz", strict=True))
    return f"""WITH c AS (SELECT CAST(a.i AS INT) AS i, CAST(b.j AS INT) AS j, CAST(d.k AS INT) AS k FROM range(0, {nx}) a(i) CROSS JOIN range(0, {ny}) b(j) CROSS JOIN range(0, {nz}) d(k)),
        p AS (SELECT i, j, k, {p} FROM c), q AS (SELECT i, j, k, x - {_CENTER[0]} AS x, y - {_CENTER[1]} AS y, z - {_CENTER[2]} AS z FROM p){extra}
        SELECT i, j, k, round(least(greatest({body}, {-band}), {band}), 6) + 0.0 AS v FROM q"""


def _around(*reach):
    return [c - r for c, r in zip(_CENTER, reach, strict=True)], [c + r for c, r in zip(_CENTER, reach, strict=True)]


_r = 2.0 + _BAND


@register("level_set_sphere", _field_sql(*_around(_r, _r, _r), "sqrt(x * x + y * y + z * z) - 2.0"))
def level_set_sphere(spark, sf_dir):
    return _rounded(levelset.sphere(spark, 2.0, _CENTER, _SIZE, _BAND), "v")


@register("level_set_box", _field_sql(*_around(1.0 + _BAND, 1.5 + _BAND, 0.5 + _BAND), """sqrt(greatest(abs(x) - 1.0, 0) * greatest(abs(x) - 1.0, 0) + greatest(abs(y) - 1.5, 0) * greatest(abs(y) - 1.5, 0) + greatest(abs(z) - 0.5, 0) * greatest(abs(z) - 0.5, 0))
    + least(greatest(abs(x) - 1.0, abs(y) - 1.5, abs(z) - 0.5), 0)"""))
def level_set_box(spark, sf_dir):
    return _rounded(levelset.box_set(spark, (1.0, 1.5, 0.5), _CENTER, _SIZE, _BAND), "v")


@register("level_set_torus", _field_sql(*_around(2.5 + _BAND, 0.5 + _BAND, 2.5 + _BAND), "sqrt((sqrt(x * x + z * z) - 2.0) * (sqrt(x * x + z * z) - 2.0) + y * y) - 0.5"))
def level_set_torus(spark, sf_dir):
    return _rounded(levelset.torus(spark, 2.0, 0.5, _CENTER, _SIZE, _BAND), "v")


_CA, _CB = (-1.0, 0.0, 0.5), (1.5, 0.5, 0.0)
_clow = [min(p, q) - 0.6 - _BAND for p, q in zip(_CA, _CB, strict=True)]
_chigh = [max(p, q) + 0.6 + _BAND for p, q in zip(_CA, _CB, strict=True)]
_CAPSULE = _field_sql(_clow, _chigh, "sqrt((x - h * 2.5) * (x - h * 2.5) + (y - h * 0.5) * (y - h * 0.5) + (z + h * 0.5) * (z + h * 0.5)) - 0.6").replace(
    "q AS (SELECT i, j, k, x - 0.1 AS x, y - -0.2 AS y, z - 0.3 AS z FROM p)",
    "r AS (SELECT i, j, k, x + 1.0 AS x, y AS y, z - 0.5 AS z FROM p), q AS (SELECT *, least(greatest((x * 2.5 + y * 0.5 - z * 0.5) / 6.75, 0), 1) AS h FROM r)",
)


@register("level_set_capsule", _CAPSULE)
def level_set_capsule(spark, sf_dir):
    return _rounded(levelset.capsule(spark, _CA, _CB, 0.6, _SIZE, _BAND), "v")


def _register_solid(faces, reach):
    planes = ", ".join(f"x * CAST({a!r} AS DOUBLE) + y * CAST({b!r} AS DOUBLE) + z * CAST({c!r} AS DOUBLE) - 1.5" for a, b, c in levelset.face_normals(faces))
    r = reach * 1.5 + _BAND
    register(f"level_set_platonic_{faces}", _field_sql(*_around(r, r, r), f"greatest({planes})"))(lambda spark, sf_dir: _rounded(levelset.platonic(spark, faces, 1.5, _CENTER, _SIZE, _BAND), "v"))


for _n, _reach in {4: 3.0, 6: 3**0.5, 8: 3**0.5, 12: 1.2584085723648188, 20: 1.2584085723648188}.items():
    _register_solid(_n, _reach)


@register("sdf_to_fog", f"WITH {DENSE_SQL} SELECT i, j, k, round(least(greatest(-v / 7, 0), 1), 6) + 0.0 AS v FROM dense")
def sdf_to_fog(spark, sf_dir):
    return _rounded(levelset.sdf_to_fog(dense(spark, sf_dir), 7.0), "v")


@register("interior_mask", f"WITH {DENSE_SQL} SELECT i, j, k, CAST(v < 1.5 AS INT) AS v FROM dense")
def interior_mask(spark, sf_dir):
    return levelset.interior_mask(dense(spark, sf_dir), 1.5)


_PARTS = "o(di, dj, dk) AS (VALUES " + ", ".join(map(str, CUBE)) + ")"
_COMPLEX = f"""WITH {A_SQL}, {_PARTS}, m AS (SELECT DISTINCT 2 * i + di AS x, 2 * j + dj AS y, 2 * k + dk AS z FROM a CROSS JOIN o),
    n AS (SELECT (x & 1) + (y & 1) + (z & 1) AS odd, count(*) AS n FROM m GROUP BY 1),
    t AS (SELECT CAST(coalesce(sum(n) FILTER (odd = 3), 0) AS BIGINT) AS v, CAST(coalesce(sum(n) FILTER (odd = 2), 0) AS BIGINT) AS e,
    CAST(coalesce(sum(n) FILTER (odd = 1), 0) AS BIGINT) AS f, CAST(coalesce(sum(n) FILTER (odd = 0), 0) AS BIGINT) AS c FROM n)"""


@register("euler_characteristic", f"{_COMPLEX} SELECT v, e, f, c, 2 * (v - e + f - c) AS euler FROM t")
def euler_characteristic(spark, sf_dir):
    return levelset.euler_characteristic(lattice(spark, sf_dir, "R"))


def _labels(offsets):
    """l(id, label): the least id that each cell of a reaches; ids are in scan order."""
    return f"""WITH RECURSIVE {A_SQL}, {offsets_sql(offsets, "near")}, cell AS (SELECT i, j, k, (CAST(k AS BIGINT) << 42) + (CAST(j AS BIGINT) << 21) + i AS id FROM a),
        link AS MATERIALIZED (SELECT t.id AS p, s.id AS q FROM cell t CROSS JOIN near JOIN cell s ON s.i = t.i + di AND s.j = t.j + dj AND s.k = t.k + dk),
        l(id, label) USING KEY (id) AS (SELECT id, id FROM cell
            UNION SELECT link.q, min(l.label) FROM l JOIN link ON link.p = l.id JOIN recurring.l AS known ON known.id = link.q WHERE l.label < known.label GROUP BY link.q)"""


_FIRST = "SELECT i, j, k, CAST(label & 2097151 AS INT) AS label_i, CAST((label >> 21) & 2097151 AS INT) AS label_j, CAST(label >> 42 AS INT) AS label_k FROM l JOIN cell USING (id)"


@register("segmentation_6", f"{_labels(FACES)} {_FIRST}")
def segmentation_6(spark, sf_dir):
    return levelset.first_cells(levelset.segmentation(lattice(spark, sf_dir, "R"), 6))


@register("segmentation_26", f"{_labels(NEAR26)} {_FIRST}")
def segmentation_26(spark, sf_dir):
    return levelset.first_cells(levelset.segmentation(lattice(spark, sf_dir, "R"), 26))


@register("genus", f"""{_labels(NEAR26)}, {_COMPLEX.split(A_SQL + ", ")[1]}, u AS (SELECT count(DISTINCT label) AS components FROM l)
    SELECT components, v - e + f - c AS chi, components - (v - e + f - c) AS genus FROM u CROSS JOIN t""")
def genus(spark, sf_dir):
    return levelset.genus(lattice(spark, sf_dir, "R"))


def _reach_sql(where):
    """open(i, j, k): the cells with the property that reach the border of the box through such cells."""
    return f"""WITH RECURSIVE {DENSE_SQL}, {offsets_sql(FACES, "near")}, able AS MATERIALIZED (SELECT i, j, k FROM dense WHERE {where}),
        open(i, j, k) AS (SELECT i, j, k FROM able WHERE i IN (0, 10) OR j IN (0, 10) OR k IN (0, 8)
            UNION SELECT able.i, able.j, able.k FROM open CROSS JOIN near JOIN able ON able.i = open.i + di AND able.j = open.j + dj AND able.k = open.k + dk)"""


@register("enclosed_regions", f"{_reach_sql('v >= 2.0')} SELECT i, j, k FROM able ANTI JOIN open USING (i, j, k)")
def enclosed_regions(spark, sf_dir):
    return levelset.enclosed_regions(dense(spark, sf_dir), DENSE_DIMS, 2.0)


@register("signed_flood_fill", f"""{_reach_sql("abs(v) >= 4.0")} SELECT d.i, d.j, d.k, CASE WHEN abs(v) < 4.0 THEN v WHEN open.i IS NULL THEN -4.0 ELSE 4.0 END AS v
    FROM dense d LEFT JOIN open ON open.i = d.i AND open.j = d.j AND open.k = d.k""")
def signed_flood_fill(spark, sf_dir):
    return levelset.signed_flood_fill(dense(spark, sf_dir), DENSE_DIMS, 4.0)


@register("brick_dilation", f"WITH {A_SQL}, {_PARTS} SELECT DISTINCT (i >> 3) + di AS i, (j >> 3) + dj AS j, (k >> 3) + dk AS k FROM a CROSS JOIN o")
def brick_dilation(spark, sf_dir):
    return levelset.tile_dilation(lattice(spark, sf_dir, "R"))


@register("fast_sweeping")
def fast_sweeping(spark, sf_dir):
    return _rounded(levelset.fast_sweeping(dense(spark, sf_dir), DENSE_DIMS, 4.0), "v")


def _part_points(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey", (F.col("p_size").cast("double") / 4 - 0.7).alias("x"), ((F.col("p_partkey") % 23).cast("double") / 2).alias("y"),
        (F.col("p_retailprice").cast("double") / 200).alias("z"),
    )


_POINTS = "pts AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 4 - 0.7 AS x, CAST(p_partkey % 23 AS DOUBLE) / 2 AS y, CAST(p_retailprice AS DOUBLE) / 200 AS z FROM part)"
_COORDS = f"""{_POINTS}, cc AS (SELECT p_partkey, least(greatest(x - 0.5, -1), 10) AS ci, least(greatest(y - 0.5, -1), 10) AS cj, least(greatest(z - 0.5, -1), 8) AS ck FROM pts),
    b AS (SELECT *, CAST(floor(ci) AS INT) AS bi, CAST(floor(cj) AS INT) AS bj, CAST(floor(ck) AS INT) AS bk, ci - floor(ci) AS fi, cj - floor(cj) AS fj, ck - floor(ck) AS fk FROM cc)"""
_LIN = "CASE s{0} WHEN 0 THEN 1 - f{0} ELSE f{0} END"
_QUAD = "CASE s{0} WHEN -1 THEN 0.5 * f{0} * f{0} - 0.5 * f{0} WHEN 0 THEN 1 - f{0} * f{0} ELSE 0.5 * f{0} * f{0} + 0.5 * f{0} END"


def _tap_sql(weight, steps, value="d.v", more=""):
    s = ", ".join(f"({x})" for x in steps)
    w = " * ".join(f"({weight.format(c)})" for c in IJK)
    return f"""WITH {DENSE_SQL}, {_COORDS}{more}, t AS (SELECT *, {w} AS w, bi + si AS ri, bj + sj AS rj, bk + sk AS rk FROM b CROSS JOIN (VALUES {s}) u(si) CROSS JOIN (VALUES {s}) v(sj) CROSS JOIN (VALUES {s}) x(sk))"""


_JOIN = "JOIN dense d ON d.i = least(greatest(ri, 0), 10) AND d.j = least(greatest(rj, 0), 10) AND d.k = least(greatest(rk, 0), 8)"


@register("sample_trilinear", f"{_tap_sql(_LIN, (0, 1))} SELECT p_partkey, round(sum(w * d.v), 6) + 0.0 AS v FROM t {_JOIN} GROUP BY 1")
def sample_trilinear(spark, sf_dir):
    return _rounded(sampling.trilinear(_part_points(spark, sf_dir), "p_partkey", dense(spark, sf_dir), DENSE_DIMS), "v")


@register("sample_quadratic", f"{_tap_sql(_QUAD, (-1, 0, 1))} SELECT p_partkey, round(sum(w * d.v), 6) + 0.0 AS v FROM t {_JOIN} GROUP BY 1")
def sample_quadratic(spark, sf_dir):
    return _rounded(sampling.quadratic(_part_points(spark, sf_dir), "p_partkey", dense(spark, sf_dir), DENSE_DIMS), "v")


@register("sample_trilinear_vec", f"{_tap_sql(_LIN, (0, 1))} SELECT p_partkey, round(sum(w * d.v), 6) + 0.0 AS x, round(sum(w * d.v * d.i), 6) + 0.0 AS y, round(sum(w * d.k), 6) + 0.0 AS z FROM t {_JOIN} GROUP BY 1")
def sample_trilinear_vec(spark, sf_dir):
    field = dense(spark, sf_dir).select(*IJK, F.col("v").alias("x"), (F.col("v") * F.col("i")).alias("y"), F.col("k").cast("double").alias("z"))
    return _rounded(sampling.trilinear(_part_points(spark, sf_dir), "p_partkey", field, DENSE_DIMS, values=("x", "y", "z")), "x", "y", "z")


@register("sample_nearest", f"""WITH {DENSE_SQL}, {_POINTS} SELECT p_partkey, d.v FROM pts JOIN dense d ON d.i = least(greatest(CAST(floor(x) AS INT), 0), 10)
    AND d.j = least(greatest(CAST(floor(y) AS INT), 0), 10) AND d.k = least(greatest(CAST(floor(z) AS INT), 0), 8)""")
def sample_nearest(spark, sf_dir):
    return sampling.nearest(_part_points(spark, sf_dir), "p_partkey", dense(spark, sf_dir), DENSE_DIMS)


def _weighed(splat, points, order):
    return splat(points, DENSE_DIMS, order=order).withColumn("w", F.col("w") * 0.9731377)


for _name, _order, _w, _s in (("splat_trilinear", 1, _LIN, (0, 1)), ("splat_quadratic", 2, _QUAD, (-1, 0, 1))):
    _sql = f"""{_tap_sql(_w, _s)} SELECT ri AS i, rj AS j, rk AS k, round(sum(w * (p_partkey % 100) / 10.27642), 5) + 0.0 AS v, round(sum(w) * 0.9731377, 5) + 0.0 AS w FROM t
        WHERE ri BETWEEN 0 AND 10 AND rj BETWEEN 0 AND 10 AND rk BETWEEN 0 AND 8 GROUP BY 1, 2, 3"""
    register(_name, _sql)(
        lambda spark, sf_dir, order=_order: _rounded(
            _weighed(sampling.splat, _part_points(spark, sf_dir).withColumn("value", (F.col("p_partkey") % 100) / 10.27642), order), "v", "w", places=5
        )
    )


def _scaled(spark, sf_dir):
    """The dense field times a number that keeps results away from rounding ties."""
    return dense(spark, sf_dir).withColumn("v", F.col("v") * 0.9731377)


@register("resample_nearest", f"""WITH {DENSE_SQL}, c AS (SELECT CAST(a.i AS INT) AS i, CAST(b.j AS INT) AS j, CAST(e.k AS INT) AS k FROM range(0, 8) a(i) CROSS JOIN range(0, 8) b(j) CROSS JOIN range(0, 6) e(k))
    SELECT c.i, c.j, c.k, d.v FROM c JOIN dense d ON d.i = least(CAST(floor((c.i + 0.5) * 1.5) AS INT), 10) AND d.j = least(CAST(floor((c.j + 0.5) * 1.5) AS INT), 10) AND d.k = least(CAST(floor((c.k + 0.5) * 1.5) AS INT), 8)""")
def resample_nearest(spark, sf_dir):
    return sampling.resample(dense(spark, sf_dir), DENSE_DIMS, 1.5, 0)


def _resample_sql(nx, ny, nz, size, weight, steps):
    cells = f"""pts AS (SELECT CAST(a.i AS INT) AS pi, CAST(b.j AS INT) AS pj, CAST(e.k AS INT) AS pk, CAST((a.i + 0.5) * {size} AS DOUBLE) AS x, CAST((b.j + 0.5) * {size} AS DOUBLE) AS y, CAST((e.k + 0.5) * {size} AS DOUBLE) AS z
        FROM range(0, {nx}) a(i) CROSS JOIN range(0, {ny}) b(j) CROSS JOIN range(0, {nz}) e(k))"""
    return _tap_sql(weight, steps).replace(_POINTS, cells).replace("SELECT p_partkey, least(", "SELECT pi, pj, pk, least(") + f" SELECT pi AS i, pj AS j, pk AS k, round(sum(w * d.v) * 0.9731377, 6) + 0.0 AS v FROM t {_JOIN} GROUP BY 1, 2, 3"


@register("resample_trilinear", _resample_sql(8, 8, 6, 1.5, _LIN, (0, 1)))
def resample_trilinear(spark, sf_dir):
    return _rounded(sampling.resample(_scaled(spark, sf_dir), DENSE_DIMS, 1.5, 1), "v")


@register("resample_quadratic", _resample_sql(8, 8, 6, 1.5, _QUAD, (-1, 0, 1)))
def resample_quadratic(spark, sf_dir):
    return _rounded(sampling.resample(_scaled(spark, sf_dir), DENSE_DIMS, 1.5, 2), "v")


@register("refine", _resample_sql(22, 22, 18, 0.5, _LIN, (0, 1)))
def refine(spark, sf_dir):
    return _rounded(sampling.refine(_scaled(spark, sf_dir), DENSE_DIMS, 2), "v")


def _rays(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key, bal = F.col("s_suppkey").cast("double"), F.col("s_acctbal").cast("double")
    return s.select(
        F.col("s_suppkey").alias("ray_id"), (key % 11).alias("ox"), (bal / 1000).alias("oy"), F.lit(-1.5).alias("oz"),
        (0.3 - (key % 7) / 10).alias("dx"), F.lit(0.2).alias("dy"), F.lit(1.0).alias("dz"), F.lit(0.0).alias("tmin"), F.lit(11.0).alias("tmax"),
    )


@register("uniform_ray_samples", """WITH r AS (SELECT s_suppkey AS ray_id, CAST(s_suppkey AS DOUBLE) % 11 AS ox, CAST(s_acctbal AS DOUBLE) / 1000 AS oy, 0.3 - (CAST(s_suppkey AS DOUBLE) % 7) / 10 AS dx FROM supplier),
    s AS (SELECT ray_id, CAST(n AS INT) AS s, ox, oy, dx, CAST(11.0 AS DOUBLE) * (CAST(n AS DOUBLE) / 8) AS t FROM r CROSS JOIN range(0, 9) x(n))
    SELECT ray_id, s, round(t, 6) + 0.0 AS t, round(ox + t * dx, 6) + 0.0 AS x, round(oy + t * 0.2, 6) + 0.0 AS y, round(-1.5 + t * 1.0, 6) + 0.0 AS z FROM s""")
def uniform_ray_samples(spark, sf_dir):
    return _rounded(sampling.uniform_ray_samples(_rays(spark, sf_dir), 9), "t", "x", "y", "z")


_RAYS = """r AS (SELECT s_suppkey AS ray_id, CAST(s_suppkey AS DOUBLE) % 11 AS ox, CAST(s_acctbal AS DOUBLE) / 1000 AS oy, CAST(0.3 AS DOUBLE) - (CAST(s_suppkey AS DOUBLE) % 7) / 10 AS dx FROM supplier),
    along AS (SELECT ray_id, CAST(n AS INT) AS s, {at} AS t, ox + {at} * dx AS x, oy + {at} * CAST(0.2 AS DOUBLE) AS y, -1.5 + {at} AS z FROM r CROSS JOIN range(0, {n}) q(n))"""


def _sampled(name, source, keys, field, *values):
    """CTEs that end in name(keys, values): the field's columns at the points x, y, z of source."""
    s = "(VALUES (0), (1))"
    w = " * ".join(f"({_LIN.format(c)})" for c in IJK)
    return f"""{name}_c AS (SELECT {keys}, least(greatest(x - 0.5, -1), 10) AS ci, least(greatest(y - 0.5, -1), 10) AS cj, least(greatest(z - 0.5, -1), 8) AS ck FROM {source}),
        {name}_b AS (SELECT *, CAST(floor(ci) AS INT) AS bi, CAST(floor(cj) AS INT) AS bj, CAST(floor(ck) AS INT) AS bk, ci - floor(ci) AS fi, cj - floor(cj) AS fj, ck - floor(ck) AS fk FROM {name}_c),
        {name}_t AS (SELECT {keys}, {w} AS w, bi + si AS ri, bj + sj AS rj, bk + sk AS rk FROM {name}_b CROSS JOIN {s} u(si) CROSS JOIN {s} v(sj) CROSS JOIN {s} x(sk)),
        {name} AS (SELECT {keys}, {", ".join(f"sum(w * d.{v}) AS {v}" for v in values)} FROM {name}_t {_JOIN.replace("JOIN dense d", f"JOIN {field} d")} GROUP BY ALL)"""


_RUNS = f"""WITH {DENSE_SQL}, {_RAYS.format(at="(CAST(11 AS DOUBLE) * n / 32)", n=33)}, {_sampled("got", "along", "ray_id, s, t", "dense", "v")},
    pair AS (SELECT *, lag(v) OVER o AS v0, lag(t) OVER o AS t0 FROM got WINDOW o AS (PARTITION BY ray_id ORDER BY s)),
    edge AS (SELECT *, v < 0 AS now, coalesce(v0 < 0, false) AS was, CASE WHEN v0 IS NULL THEN t WHEN v0 * v < 0 THEN t0 + v0 / (v0 - v) * (t - t0) WHEN v0 = 0 THEN t0 ELSE t END AS met FROM pair),
    number AS (SELECT *, sum(CAST(now AND NOT was AS INT)) OVER (PARTITION BY ray_id ORDER BY s) AS run FROM edge),
    runs AS (SELECT ray_id, CAST(run - 1 AS INT) AS run, min(CASE WHEN now AND NOT was THEN met END) AS t_in, coalesce(min(CASE WHEN was AND NOT now THEN met END), 11.0) AS t_out FROM number WHERE run > 0 GROUP BY 1, 2)"""


@register("segments_along_ray", f"{_RUNS} SELECT ray_id, run, round(t_in, 6) + 0.0 AS t_in, round(t_out, 6) + 0.0 AS t_out FROM runs")
def segments_along_ray(spark, sf_dir):
    return _rounded(sampling.segments_along_ray(_rays(spark, sf_dir), dense(spark, sf_dir), DENSE_DIMS, 33), "t_in", "t_out")


@register("ray_cast", f"{_RUNS} SELECT ray_id, round(min(t_in), 6) + 0.0 AS t FROM runs GROUP BY 1")
def ray_cast(spark, sf_dir):
    return _rounded(sampling.ray_cast(_rays(spark, sf_dir), dense(spark, sf_dir), DENSE_DIMS, 33), "t")


def _slab_sql(o, d, cell):
    """When a ray is within a cell's slab: from, to; a ray along the slab is always in its own."""
    still = f"abs({d}) <= 1e-12"
    own = f"floor({o}) = {cell}"
    ends = [f"(({cell} + {n}) - {o}) / {d}" for n in (0, 1)]
    return f"CASE WHEN {still} THEN CASE WHEN {own} THEN -1e9 ELSE 1e9 END ELSE least({ends[0]}, {ends[1]}) END", f"CASE WHEN {still} THEN 1e9 ELSE greatest({ends[0]}, {ends[1]}) END"


_SLABS = [_slab_sql(o, d, c) for o, d, c in (("ox", "dx", "i"), ("oy", "CAST(0.2 AS DOUBLE)", "j"), ("CAST(-1.5 AS DOUBLE)", "CAST(1 AS DOUBLE)", "k"))]


@register("voxels_along_ray", f"""WITH {DENSE_SQL}, {_RAYS.format(at="n", n=1)} SELECT ray_id, i, j, k FROM r CROSS JOIN dense
    WHERE greatest(0, {", ".join(low for low, _ in _SLABS)}) < least(11, {", ".join(high for _, high in _SLABS)})""")
def voxels_along_ray(spark, sf_dir):
    return sampling.voxels_along_ray(_rays(spark, sf_dir), DENSE_DIMS)


@register("volume_render", f"""WITH {DENSE_SQL}, fog AS (SELECT i, j, k, least(greatest(-v / 7, 0), 1) AS v FROM dense), {_RAYS.format(at="((n + CAST(0.5 AS DOUBLE)) * CAST(11 AS DOUBLE) / 32)", n=32)},
    {_sampled("got", "along", "ray_id, s", "fog", "v")}, th AS (SELECT ray_id, s, greatest(v, 0) * CAST(0.6 AS DOUBLE) * 11 / 32 AS thick FROM got),
    bf AS (SELECT *, coalesce(sum(thick) OVER (PARTITION BY ray_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM th)
    SELECT ray_id, round(1 - exp(-sum(thick)) + exp(-sum(thick)) * 0.25, 6) + 0.0 AS pixel FROM bf WHERE exp(-before) > 1e-3 GROUP BY 1""")
def volume_render(spark, sf_dir):
    fog = levelset.sdf_to_fog(dense(spark, sf_dir), 7.0)
    return _rounded(sampling.volume_render(_rays(spark, sf_dir), fog, DENSE_DIMS, 32, 0.6, 0.25), "pixel")


_FRAME = {"fx": 9.0, "fy": 9.0, "cx": 8.0, "cy": 8.0, "width": 16, "height": 16, "pose": [1.0, 0, 0, 5.5, 0, 1.0, 0, 5.5, 0, 0, 1.0, -4.0], "trunc": 2.5, "dmin": 0.5, "dmax": 20.0}


@register("integrate_tsdf", f"""WITH {DENSE_SQL}, px AS (SELECT u, v, 3.0 + (u * 7 + v * 3) % 11 * 0.7 AS depth FROM range(0, 16) a(u) CROSS JOIN range(0, 16) b(v)),
    g AS (SELECT i, j, k, v / 10 AS v, 2.0 AS w, i + 0.5 - 5.5 AS x, j + 0.5 - 5.5 AS y, k + 0.5 + 4.0 AS z FROM dense),
    m AS (SELECT g.i, g.j, g.k, g.v, g.w, CASE WHEN px.depth - z >= -2.5 THEN least(px.depth - z, 2.5) END AS s FROM g LEFT JOIN px
    ON px.u = floor(9.0 * x / z + 8.0 + 0.5) AND px.v = floor(9.0 * y / z + 8.0 + 0.5) AND px.depth BETWEEN 0.5 AND 20.0)
    SELECT i, j, k, round(CASE WHEN s IS NULL THEN v ELSE (v * w + s) / (w + 1) END, 6) + 0.0 AS v, CAST(CASE WHEN s IS NULL THEN w ELSE w + 1 END AS DOUBLE) AS w FROM m""")
def integrate_tsdf(spark, sf_dir):
    n = F.col("id")
    pixels = spark.range(256).select((n % 16).cast("int").alias("u"), F.floor(n / 16).cast("int").alias("v"))
    pixels = pixels.withColumn("depth", 3.0 + (F.col("u") * 7 + F.col("v") * 3) % 11 * 0.7)
    voxels = dense(spark, sf_dir).select(*IJK, (F.col("v") / 10).alias("v"), F.lit(2.0).alias("w"))
    return _rounded(sampling.integrate_tsdf(voxels, pixels, _FRAME, 1.0), "v")


@register("integrate_tsdf_color", f"""WITH {DENSE_SQL}, px AS (SELECT u, v, 3.0 + (u * 7 + v * 3) % 11 * 0.7 AS depth, CAST(u * 15 AS DOUBLE) AS r, CAST(v * 13 AS DOUBLE) AS g, CAST((u + v) * 8 AS DOUBLE) AS b FROM range(0, 16) a(u) CROSS JOIN range(0, 16) b(v)),
    g AS (SELECT i, j, k, v / 10 AS v, 2.0 AS w, i * 10 AS r0, j * 10 AS g0, k * 10 AS b0, i + 0.5 - 5.5 AS x, j + 0.5 - 5.5 AS y, k + 0.5 + 4.0 AS z FROM dense),
    m AS (SELECT g.*, px.r, px.g, px.b, CASE WHEN px.depth - z >= -2.5 THEN least(px.depth - z, 2.5) END AS s FROM g LEFT JOIN px
    ON px.u = floor(9.0 * x / z + 8.0 + 0.5) AND px.v = floor(9.0 * y / z + 8.0 + 0.5) AND px.depth BETWEEN 0.5 AND 20.0)
    SELECT i, j, k, round(CASE WHEN s IS NULL THEN v ELSE (v * w + s) / (w + 1) END, 6) + 0.0 AS v, CAST(CASE WHEN s IS NULL THEN w ELSE w + 1 END AS DOUBLE) AS w,
    round(CASE WHEN s IS NULL THEN r0 ELSE (r0 * w + r) / (w + 1) END, 6) + 0.0 AS r, round(CASE WHEN s IS NULL THEN g0 ELSE (g0 * w + g) / (w + 1) END, 6) + 0.0 AS g, round(CASE WHEN s IS NULL THEN b0 ELSE (b0 * w + b) / (w + 1) END, 6) + 0.0 AS b FROM m""")
def integrate_tsdf_color(spark, sf_dir):
    n = F.col("id")
    pixels = spark.range(256).select((n % 16).cast("int").alias("u"), F.floor(n / 16).cast("int").alias("v"))
    pixels = pixels.withColumn("depth", 3.0 + (F.col("u") * 7 + F.col("v") * 3) % 11 * 0.7)
    pixels = pixels.withColumns({"r": F.col("u") * 15.0, "g": F.col("v") * 13.0, "b": (F.col("u") + F.col("v")) * 8.0})
    voxels = dense(spark, sf_dir).select(*IJK, (F.col("v") / 10).alias("v"), F.lit(2.0).alias("w"), (F.col("i") * 10.0).alias("r"), (F.col("j") * 10.0).alias("g"), (F.col("k") * 10.0).alias("b"))
    return _rounded(sampling.integrate_tsdf(voxels, pixels, _FRAME, 1.0, colors=("r", "g", "b")), "v", "r", "g", "b")


@register("apply_affine", f"""WITH {_POINTS} SELECT p_partkey, round(x * 0.5 + y * -0.25 + z * 0.1 + 1, 6) + 0.0 AS x, round(x * 0.0 + y * 2 + z * 1 - 3, 6) + 0.0 AS y, round(x * -1 + y * 0.0 + z * 0.75 + 0.5, 6) + 0.0 AS z FROM pts""")
def apply_affine(spark, sf_dir):
    return _rounded(sampling.apply_affine(_part_points(spark, sf_dir), [0.5, -0.25, 0.1, 1.0, 0.0, 2.0, 1.0, -3.0, -1.0, 0.0, 0.75, 0.5]), "x", "y", "z")


def _wind(spark, sf_dir):
    d = dense(spark, sf_dir)
    return d, d.select(*IJK, (F.col("j") / 10.0).alias("x"), F.lit(0.3).alias("y"), (F.col("v") / 40).alias("z"))


#: For each order, where each stage looks (weights of the stages before) and how the stages are summed.
_LOOKS = {1: [[]], 2: [[], [1 / 2]], 3: [[], [1 / 2], [-1, 2]], 4: [[], [1 / 2], [0, 1 / 2], [0, 0, 1]]}
_SUMS = {1: [1], 2: [0, 1], 3: [1 / 6, 2 / 3, 1 / 6], 4: [1 / 6, 1 / 3, 1 / 3, 1 / 6]}
_WIND = f"WITH {DENSE_SQL}, wind AS (SELECT i, j, k, CAST(j / 10.0 AS DOUBLE) AS x, CAST(0.3 AS DOUBLE) AS y, v / 40 AS z FROM dense)"


def _carried(name, field, step, order):
    """CTEs that end in name(i, j, k, v): the field where each cell's content came from."""

    def place(at, weights):
        tables = "".join(f" JOIN {name}_k{n} k{n} USING (pi, pj, pk)" for n in range(1, len(weights)))
        moved = ", ".join(
            f"{p} + 0.5 - CAST({step} AS DOUBLE) * ({' + '.join([f'CAST({w!r} AS DOUBLE) * k{n}.{x}' for n, w in enumerate(weights)])}) AS {x}" for p, x in zip(("pi", "pj", "pk"), "xyz", strict=True)
        )
        return f"{at} AS (SELECT pi, pj, pk, {moved} FROM {name}_k0 k0{tables})"

    out = [f"{name}_k0 AS (SELECT i AS pi, j AS pj, k AS pk, x, y, z FROM wind)"]
    for n, weights in enumerate(_LOOKS[order][1:], 1):
        out += [place(f"{name}_p{n}", weights), _sampled(f"{name}_k{n}", f"{name}_p{n}", "pi, pj, pk", "wind", "x", "y", "z")]
    out += [place(f"{name}_end", _SUMS[order]), _sampled(f"{name}_got", f"{name}_end", "pi, pj, pk", field, "v")]
    return ", ".join([*out, f"{name} AS (SELECT pi AS i, pj AS j, pk AS k, v FROM {name}_got)"])


_THERE_BACK = f"{_WIND}, {_carried('there', 'dense', 0.7, 2)}, {_carried('back', 'there', -0.7, 2)}"
_HALF = "(d.v - b.v) / 2 AS v FROM dense d JOIN back b USING (i, j, k)"
_SCHEMES = {
    "maccormack": f"{_THERE_BACK} SELECT i, j, k, round(t.v + (d.v - b.v) / 2, 6) + 0.0 AS v FROM dense d JOIN back b USING (i, j, k) JOIN there t USING (i, j, k)",
    "bfecc": f"{_THERE_BACK}, better AS (SELECT i, j, k, d.v + {_HALF}), {_carried('last', 'better', 0.7, 2)} SELECT i, j, k, round(v, 6) + 0.0 AS v FROM last",
}

for _order in (1, 2, 3, 4):
    _sql = f"{_WIND}, {_carried('got', 'dense', 0.7, _order)} SELECT i, j, k, round(v, 6) + 0.0 AS v FROM got"
    register(f"advect_rk{_order}", _sql)(lambda spark, sf_dir, order=_order: _rounded(sampling.advect(*_placed(_wind(spark, sf_dir)), 0.7, order), "v"))
for _scheme, _sql in _SCHEMES.items():
    register(f"advect_{_scheme}", _sql)(lambda spark, sf_dir, scheme=_scheme: _rounded(sampling.advect(*_placed(_wind(spark, sf_dir)), 0.7, 2, scheme), "v"))


def _placed(pair):
    return pair[0], DENSE_DIMS, pair[1]


@register("volume_to_spheres")
def volume_to_spheres(spark, sf_dir):
    return _rounded(sampling.volume_to_spheres(dense(spark, sf_dir), 12, 0.1), "x", "y", "z", "r")


@register("particles_to_sdf", f"""WITH {DENSE_SQL}, p AS (SELECT CAST(s_suppkey AS DOUBLE) % 11 + 0.3 AS x, CAST(s_acctbal AS DOUBLE) / 1000 AS y, CAST(s_suppkey AS DOUBLE) % 9 + 0.1 AS z, 0.4 + (s_suppkey % 3) * 0.2 AS r FROM supplier)
    SELECT i, j, k, round(least(greatest(min(sqrt((i + 0.5 - x) * (i + 0.5 - x) + (j + 0.5 - y) * (j + 0.5 - y) + (k + 0.5 - z) * (k + 0.5 - z)) - r), -1.5), 1.5), 6) + 0.0 AS v FROM dense CROSS JOIN p GROUP BY 1, 2, 3""")
def particles_to_sdf(spark, sf_dir):
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    particles = s.select((key.cast("double") % 11 + 0.3).alias("x"), (F.col("s_acctbal").cast("double") / 1000).alias("y"), (key.cast("double") % 9 + 0.1).alias("z"), (0.4 + (key % 3) * 0.2).alias("r"))
    return _rounded(sampling.particles_to_sdf(dense(spark, sf_dir), particles, 1.5), "v")
