"""Queries over statistics, lists, stencils and pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import A_SQL, B_SQL, CUBE, DENSE_DIMS, DENSE_SQL, FACES, IJK, dense, lattice, offsets_sql, table
from ..operators import stats, stencil
from .registry import register


def _rounded(df, *columns, places=6):
    """Rounded, and without a negative zero."""
    out = df
    for c in columns:
        out = out.withColumn(c, F.round(c, places) + F.lit(0.0))
    return out


@register("grid_statistics", f"""WITH {DENSE_SQL} SELECT round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean,
    round(stddev_pop(v), 6) AS stddev, round(sum(v), 6) AS sum, count(v) AS count FROM dense""")
def grid_statistics(spark, sf_dir):
    return _rounded(stats.grid_statistics(dense(spark, sf_dir)), "min", "max", "mean", "stddev", "sum")


@register("grid_histogram", """WITH d AS (SELECT CAST(n_chars AS DOUBLE) AS v FROM documents), b AS (SELECT CAST(range AS INT) AS bin FROM range(0, 20)),
    c AS (SELECT CAST(greatest(0, least(19, floor(v / 5000 * 20))) AS INT) AS bin, count(*) AS n FROM d GROUP BY 1)
    SELECT b.bin, coalesce(c.n, 0) AS n FROM b LEFT JOIN c USING (bin)""")
def grid_histogram(spark, sf_dir):
    return stats.grid_histogram(table(spark, sf_dir, "documents").select(F.col("n_chars").alias("v")), 0.0, 5000.0, 20)


_TAP = "JOIN dense s ON s.i = least(greatest(t.i + o.di, 0), 10) AND s.j = least(greatest(t.j + o.dj, 0), 10) AND s.k = least(greatest(t.k + o.dk, 0), 8)"
_GRAD = f"""g AS (SELECT t.i, t.j, t.k, t.v,
    CASE WHEN t.i IN (0, 10) THEN 1.0 ELSE 0.5 END * (sum(CASE WHEN o.di = 1 THEN s.v END) - sum(CASE WHEN o.di = -1 THEN s.v END)) AS gx,
    CASE WHEN t.j IN (0, 10) THEN 1.0 ELSE 0.5 END * (sum(CASE WHEN o.dj = 1 THEN s.v END) - sum(CASE WHEN o.dj = -1 THEN s.v END)) AS gy,
    CASE WHEN t.k IN (0, 8) THEN 1.0 ELSE 0.5 END * (sum(CASE WHEN o.dk = 1 THEN s.v END) - sum(CASE WHEN o.dk = -1 THEN s.v END)) AS gz
    FROM dense t CROSS JOIN o {_TAP} GROUP BY t.i, t.j, t.k, t.v)"""
_O6 = offsets_sql(FACES)


@register("gradient", f"WITH {DENSE_SQL}, {_O6}, {_GRAD} SELECT i, j, k, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy, round(gz, 6) + 0.0 AS gz FROM g")
def gradient(spark, sf_dir):
    return _rounded(stencil.gradient(dense(spark, sf_dir), DENSE_DIMS).drop("v"), "gx", "gy", "gz")


@register("check_level_set", f"""WITH {DENSE_SQL}, {_O6}, {_GRAD}, i AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS m FROM g
    WHERE i BETWEEN 1 AND 9 AND j BETWEEN 1 AND 9 AND k BETWEEN 1 AND 7 AND abs(v) <= 15)
    SELECT round(avg(m), 6) AS mean_gradient, round(max(abs(m - 1)), 6) AS max_error, round(avg(CASE WHEN abs(m - 1) > 3 THEN 1.0 ELSE 0.0 END), 6) AS bad_part, count(*) AS n FROM i""")
def check_level_set(spark, sf_dir):
    g = stencil.gradient(dense(spark, sf_dir), DENSE_DIMS)
    for c, n in zip(IJK, DENSE_DIMS, strict=True):
        g = g.where(F.col(c).between(1, n - 2))
    return _rounded(stats.check_level_set(g, 15.0, 3.0), "mean_gradient", "max_error", "bad_part")


@register("check_fog_volume", f"""WITH {DENSE_SQL} SELECT round(min(v / 30), 6) AS lo, round(max(v / 30), 6) AS hi, CAST(0 AS BIGINT) AS nonfinite,
    bool_and(v / 30 BETWEEN -1e-6 AND 1 + 1e-6) AS valid FROM dense""")
def check_fog_volume(spark, sf_dir):
    return _rounded(stats.check_fog_volume(dense(spark, sf_dir).withColumn("v", F.col("v") / 30)), "lo", "hi")


@register("surface_area", f"""WITH {DENSE_SQL} SELECT CAST(sum(CASE WHEN (a.v < 0) <> (b.v < 0) THEN 1 ELSE 0 END) AS BIGINT) AS faces,
    CAST(sum(CASE WHEN (a.v < 0) <> (b.v < 0) THEN 1 ELSE 0 END) AS DOUBLE) * 0.25 AS area FROM dense a JOIN dense b
    ON (b.i = a.i + 1 AND b.j = a.j AND b.k = a.k) OR (b.i = a.i AND b.j = a.j + 1 AND b.k = a.k) OR (b.i = a.i AND b.j = a.j AND b.k = a.k + 1)""")
def surface_area(spark, sf_dir):
    return stats.surface_area(dense(spark, sf_dir), 0.5)


@register("volume", f"WITH {DENSE_SQL} SELECT CAST(count(*) FILTER (v < 0) AS DOUBLE) * 0.125 AS volume FROM dense")
def volume(spark, sf_dir):
    return stats.volume(dense(spark, sf_dir), 0.5)


@register("active_bbox", f"WITH {A_SQL} SELECT min(i) AS min_i, min(j) AS min_j, min(k) AS min_k, max(i) + 1 AS max_i, max(j) + 1 AS max_j, max(k) + 1 AS max_k FROM a")
def active_bbox(spark, sf_dir):
    return stats.active_bbox(lattice(spark, sf_dir, "R"))


@register("active_voxel_count", f"WITH {A_SQL} SELECT count(*) + 512 + 4096 AS n FROM a")
def active_voxel_count(spark, sf_dir):
    tiles = spark.createDataFrame([(8, True), (16, True), (128, False)], "span int, active boolean")
    return stats.active_voxel_count(lattice(spark, sf_dir, "R"), tiles)


def _batch(spark, sf_dir):
    return stats.grid_batch(lattice(spark, sf_dir, "R"), lattice(spark, sf_dir, "A"))


_BATCH = f"WITH {A_SQL}, {B_SQL}, g AS (SELECT 0 AS grid_id, * FROM a UNION ALL SELECT 1, * FROM b)"


@register("grid_info", f"""{_BATCH} SELECT grid_id, min(i) AS min_i, min(j) AS min_j, min(k) AS min_k, max(i) AS max_i, max(j) AS max_j, max(k) AS max_k, count(*) AS active FROM g GROUP BY 1""")
def grid_info(spark, sf_dir):
    return stats.grid_info(_batch(spark, sf_dir))


@register("grid_batch", f"{_BATCH} SELECT grid_id, i, j, k, v FROM g")
def grid_batch(spark, sf_dir):
    return _batch(spark, sf_dir)


@register("grid_batch_sizes", f"{_BATCH} SELECT grid_id, count(*) AS n FROM g GROUP BY 1")
def grid_batch_sizes(spark, sf_dir):
    return _batch(spark, sf_dir).groupBy("grid_id").agg(F.count("*").alias("n"))


@register("grid_batch_ijk_to_index", f"""{_BATCH}, o AS (SELECT grid_id, i, j, k, row_number() OVER (PARTITION BY grid_id ORDER BY i, j, k) - 1 AS ord FROM g)
    SELECT q.gid AS grid_id, p_partkey, coalesce(o.ord, -1) AS "index" FROM (SELECT CAST(p_partkey % 2 AS INT) AS gid, p_partkey, CAST(p_size AS INT) AS i,
    CAST(floor(p_retailprice / 50) AS INT) AS j, CAST(p_partkey % 11 AS INT) AS k FROM part) q
    LEFT JOIN o ON o.grid_id = q.gid AND o.i = q.i AND o.j = q.j AND o.k = q.k""")
def grid_batch_ijk_to_index(spark, sf_dir):
    from ..operators import index

    part = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 2).cast("int").alias("grid_id"), "p_partkey", F.col("p_size").cast("int").alias("i"),
        F.floor(F.col("p_retailprice") / 50).cast("int").alias("j"), (F.col("p_partkey") % 11).cast("int").alias("k"),
    )
    out = None
    for n, flag in enumerate("RA"):
        found = index.ijk_to_index(part.where(F.col("grid_id") == n), index.ordered(lattice(spark, sf_dir, flag), *IJK))
        out = found if out is None else out.unionByName(found)
    return out.select("grid_id", "p_partkey", "index")


@register("diagnose", f"""WITH {DENSE_SQL}, b AS (SELECT i, j, k FROM dense WHERE v NOT BETWEEN -18 AND 20 ORDER BY i, j, k LIMIT 1)
    SELECT CAST(0 AS BIGINT) AS nonfinite, (SELECT count(*) FROM dense WHERE v NOT BETWEEN -18 AND 20) AS out_of_range,
    (SELECT i FROM b) AS first_i, (SELECT j FROM b) AS first_j, (SELECT k FROM b) AS first_k, count(*) AS active FROM dense""")
def diagnose(spark, sf_dir):
    return stats.diagnose(dense(spark, sf_dir), -18.0, 20.0)


_POOL = f"WITH {DENSE_SQL} SELECT CAST(floor(i / 2) AS INT) AS i, CAST(floor(j / 3) AS INT) AS j, CAST(floor(k / 2) AS INT) AS k, {{}} AS v FROM dense GROUP BY 1, 2, 3"


@register("max_pool", _POOL.format("max(v)"))
def max_pool(spark, sf_dir):
    return stats.pool(dense(spark, sf_dir), (2, 3, 2), "max")


@register("avg_pool", _POOL.format("round(avg(v), 6)"))
def avg_pool(spark, sf_dir):
    return _rounded(stats.pool(dense(spark, sf_dir), (2, 3, 2), "avg"), "v")


@register("coarsen", f"WITH {DENSE_SQL} SELECT i // 3 AS i, j // 3 AS j, k // 3 AS k, round(avg(v), 6) + 0.0 AS v FROM dense GROUP BY 1, 2, 3")
def coarsen(spark, sf_dir):
    return _rounded(stats.pool(dense(spark, sf_dir), (3, 3, 3), "avg"), "v")


@register("to_dense_volume", f"""WITH {DENSE_SQL} SELECT (i - 1) // 2 AS i, (j - 1) // 2 AS j, k // 2 AS k, round(avg(CASE WHEN v > -10 THEN v ELSE 3.0 END), 6) AS v
    FROM dense WHERE i BETWEEN 1 AND 9 AND j BETWEEN 1 AND 10 AND k BETWEEN 0 AND 6 GROUP BY 1, 2, 3""")
def to_dense_volume(spark, sf_dir):
    rows = dense(spark, sf_dir).withColumn("active", F.col("v") > -10)
    return _rounded(stats.strided_window(rows, (1, 1, 0), (10, 11, 7), 2, 3.0), "v")


def _lists(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").cast("long").alias("list_id"), "ts", "event_id", F.col("value").cast("double").alias("v"))
    return rows.select("list_id", "ts", "event_id", F.explode(F.array(F.struct(F.lit(0).alias("ch"), F.col("v").alias("v")), F.struct(F.lit(1).alias("ch"), (-F.col("v") / 2).alias("v")))).alias("c")).select("list_id", "ts", "event_id", "c.ch", "c.v")


def _every(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.explode(F.array(F.col("user_id").cast("long"), F.col("user_id").cast("long") + 1)).alias("list_id")).distinct()
    return ids.select("list_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ch"))


for _op, _f in {"sum": "sum", "mean": "avg", "max": "max", "min": "min"}.items():
    _sql = f"""WITH l AS (SELECT CAST(user_id AS BIGINT) AS list_id, c AS ch, CASE c WHEN 0 THEN CAST(value AS DOUBLE) ELSE -CAST(value AS DOUBLE) / 2 END AS v
        FROM events CROSS JOIN (VALUES (0), (1)) x(c)), e AS (SELECT DISTINCT CAST(user_id AS BIGINT) + y AS list_id, c AS ch FROM events CROSS JOIN (VALUES (0), (1)) x(c) CROSS JOIN (VALUES (0), (1)) z(y))
        SELECT e.list_id, e.ch, round(coalesce({_f}(l.v), 0.0), 4) + 0.0 AS v FROM e LEFT JOIN l USING (list_id, ch) GROUP BY 1, 2"""
    register(f"jagged_{_op}", _sql)(lambda spark, sf_dir, op=_op: _rounded(stats.jagged_reduce(_lists(spark, sf_dir), op, _every(spark, sf_dir)), "v", places=4))


@register("jagged_from_rows", "SELECT CAST(user_id AS BIGINT) AS list_id, list(CAST(value AS DOUBLE) ORDER BY ts, event_id) AS \"values\" FROM events GROUP BY 1")
def jagged_from_rows(spark, sf_dir):
    return stats.jagged_from_rows(_lists(spark, sf_dir).where("ch = 0"), ["ts", "event_id"])


@register("jagged_sizes", "SELECT CAST(user_id AS BIGINT) AS list_id, count(*) AS n FROM events GROUP BY 1")
def jagged_sizes(spark, sf_dir):
    return stats.jagged_sizes(_lists(spark, sf_dir).where("ch = 0"))


@register("jagged_concat", """WITH l AS (SELECT CAST(vec_id AS BIGINT) AS list_id, CAST(p - 1 AS INT) AS pos, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(p))
    SELECT list_id, pos, v FROM l UNION ALL SELECT list_id + 100000, pos, v * 2 FROM l WHERE pos < 4""")
def jagged_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("list_id"), F.posexplode("embedding").alias("pos", "v"))
    rows = rows.withColumn("v", F.col("v").cast("double"))
    return stats.jagged_concat(rows, rows.where("pos < 4").withColumn("v", F.col("v") * 2), 100000)


def _morph(op):
    return f"WITH {DENSE_SQL}, {offsets_sql(((0, 0, 0), *FACES))} SELECT t.i, t.j, t.k, {op}(s.v) AS v FROM dense t CROSS JOIN o {_TAP} GROUP BY 1, 2, 3"


def _twice(first, second):
    tap = _TAP.replace("JOIN dense s", "JOIN m s")
    return f"""WITH {DENSE_SQL}, {offsets_sql(((0, 0, 0), *FACES))}, m AS (SELECT t.i, t.j, t.k, {first}(s.v) AS v FROM dense t CROSS JOIN o {_TAP} GROUP BY 1, 2, 3)
        SELECT t.i, t.j, t.k, {second}(s.v) AS v FROM m t CROSS JOIN o {tap} GROUP BY 1, 2, 3"""


@register("dilate", _morph("min"))
def dilate(spark, sf_dir):
    return stencil.morph(dense(spark, sf_dir), DENSE_DIMS, "dilate")


@register("erode", _morph("max"))
def erode(spark, sf_dir):
    return stencil.morph(dense(spark, sf_dir), DENSE_DIMS, "erode")


@register("open", _twice("max", "min"))
def opened(spark, sf_dir):
    return stencil.opened(dense(spark, sf_dir), DENSE_DIMS)


@register("close", _twice("min", "max"))
def closed(spark, sf_dir):
    return stencil.closed(dense(spark, sf_dir), DENSE_DIMS)


def _passes(weights):
    """Three axis passes as gathers with clamped taps."""
    radius = len(weights) // 2
    taps = ", ".join(f"({n - radius}, CAST({w!r} AS DOUBLE))" for n, w in enumerate(weights))
    out, last = f"WITH {DENSE_SQL}, w(d, w) AS (VALUES {taps})", "dense"
    for axis, top in (("i", 10), ("j", 10), ("k", 8)):
        on = " AND ".join(f"s.{c} = least(greatest(t.{c} + d, 0), {top})" if c == axis else f"s.{c} = t.{c}" for c in IJK)
        out += f", p{axis} AS (SELECT t.i, t.j, t.k, sum(w * s.v) AS v FROM {last} t CROSS JOIN w JOIN {last} s ON {on} GROUP BY 1, 2, 3)"
        last = f"p{axis}"
    return f"{out} SELECT i, j, k, round(v, 6) + 0.0 AS v FROM {last}"


@register("mean_filter", _passes([1 / 5] * 5))
def mean_filter(spark, sf_dir):
    return _rounded(stencil.mean_filter(dense(spark, sf_dir), 2), "v")


@register("gaussian_filter", _passes(stencil.gaussian_weights(2, 1.0)))
def gaussian_filter(spark, sf_dir):
    return _rounded(stencil.gaussian_filter(dense(spark, sf_dir), 2), "v")


@register("laplacian_filter", f"WITH {DENSE_SQL}, {_O6} SELECT t.i, t.j, t.k, round(min(t.v) + (sum(s.v) - 6 * min(t.v)) / 8, 6) + 0.0 AS v FROM dense t CROSS JOIN o {_TAP} GROUP BY 1, 2, 3")
def laplacian_filter(spark, sf_dir):
    return _rounded(stencil.laplacian_filter(dense(spark, sf_dir)), "v")


@register("laplacian", f"WITH {DENSE_SQL}, {_O6} SELECT t.i, t.j, t.k, round((sum(s.v) - 6 * min(t.v)) / 0.25, 6) + 0.0 AS v FROM dense t CROSS JOIN o {_TAP} GROUP BY 1, 2, 3")
def laplacian(spark, sf_dir):
    return _rounded(stencil.laplacian(dense(spark, sf_dir), 0.5), "v")


@register("median_filter", f"WITH {DENSE_SQL}, {offsets_sql(CUBE)} SELECT t.i, t.j, t.k, median(s.v) AS v FROM dense t CROSS JOIN o {_TAP} GROUP BY 1, 2, 3")
def median_filter(spark, sf_dir):
    return stencil.median_filter(dense(spark, sf_dir), DENSE_DIMS)


def _vectors(spark, sf_dir):
    return dense(spark, sf_dir).select(*IJK, F.col("v").alias("x"), (F.col("v") * F.col("j") / 10).alias("y"), (F.col("v") * F.col("i") - F.col("k")).alias("z"))


def _vec_sql(body):
    """d{axis}{component}: differences of the vector field."""
    parts = []
    for axis, d, top in (("i", "di", 10), ("j", "dj", 10), ("k", "dk", 8)):
        for c in "xyz":
            parts.append(f"CASE WHEN t.{axis} IN (0, {top}) THEN 1.0 ELSE 0.5 END * (sum(CASE WHEN o.{d} = 1 THEN s.{c} END) - sum(CASE WHEN o.{d} = -1 THEN s.{c} END)) AS {d}{c}")
    return f"""WITH {DENSE_SQL}, {_O6}, vec AS (SELECT i, j, k, v AS x, v * j / 10 AS y, v * i - k AS z FROM dense),
        g AS (SELECT t.i, t.j, t.k, {", ".join(parts)} FROM vec t CROSS JOIN o {_TAP.replace("dense s", "vec s")} GROUP BY t.i, t.j, t.k) SELECT i, j, k, {body} FROM g"""


@register("divergence", _vec_sql("round(dix + djy + dkz, 6) + 0.0 AS v"))
def divergence(spark, sf_dir):
    return _rounded(stencil.divergence(_vectors(spark, sf_dir), DENSE_DIMS), "v")


@register("curl", _vec_sql("round(djz - dky, 6) + 0.0 AS x, round(dkx - diz, 6) + 0.0 AS y, round(diy - djx, 6) + 0.0 AS z"))
def curl(spark, sf_dir):
    return _rounded(stencil.curl(_vectors(spark, sf_dir), DENSE_DIMS), "x", "y", "z")


_VEC = f"WITH {DENSE_SQL}, vec AS (SELECT i, j, k, v AS x, v * j / 10 AS y, v * i - k AS z FROM dense)"


@register("magnitude", f"{_VEC} SELECT i, j, k, round(sqrt(x * x + y * y + z * z), 6) AS v FROM vec")
def magnitude(spark, sf_dir):
    return _rounded(stencil.magnitude(_vectors(spark, sf_dir)), "v")


@register("normalize_vec", f"{_VEC}, m AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM vec) SELECT i, j, k, round(CASE WHEN n > 0 THEN x / n ELSE 0 END, 6) + 0.0 AS x, round(CASE WHEN n > 0 THEN y / n ELSE 0 END, 6) + 0.0 AS y, round(CASE WHEN n > 0 THEN z / n ELSE 0 END, 6) + 0.0 AS z FROM m")
def normalize_vec(spark, sf_dir):
    return _rounded(stencil.normalize(_vectors(spark, sf_dir)), "x", "y", "z")


@register("cpt", f"WITH {DENSE_SQL}, {_O6}, {_GRAD} SELECT i, j, k, round(i + 0.5 - v * gx, 6) + 0.0 AS x, round(j + 0.5 - v * gy, 6) + 0.0 AS y, round(k + 0.5 - v * gz, 6) + 0.0 AS z FROM g")
def cpt(spark, sf_dir):
    return _rounded(stencil.closest_points(dense(spark, sf_dir), DENSE_DIMS), "x", "y", "z")


@register("dilate_sparse", f"""WITH {A_SQL}, {offsets_sql(((0, 0, 0), *FACES))}, s AS (SELECT a.i + di AS i, a.j + dj AS j, a.k + dk AS k, v, di = 0 AND dj = 0 AND dk = 0 AS own FROM a CROSS JOIN o)
    SELECT i, j, k, CASE WHEN bool_or(own) THEN min(v) ELSE least(min(v), CAST(30000 AS FLOAT)) END AS v FROM s GROUP BY 1, 2, 3""")
def dilate_sparse(spark, sf_dir):
    return stencil.dilate_sparse(lattice(spark, sf_dir, "R"), 30000.0)


@register("erode_sparse", f"""WITH {A_SQL}, {offsets_sql(((0, 0, 0), *FACES))} SELECT t.i, t.j, t.k, max(s.v) AS v FROM a t CROSS JOIN o
    JOIN a s ON s.i = t.i + di AND s.j = t.j + dj AND s.k = t.k + dk GROUP BY 1, 2, 3 HAVING count(*) = 7""")
def erode_sparse(spark, sf_dir):
    return stencil.erode_sparse(lattice(spark, sf_dir, "R"))


def _stored(spark, sf_dir):
    return lattice(spark, sf_dir, "R").withColumn("active", F.col("j") % 3 != 0)


for _op, _f in {"dilate": "min", "erode": "max"}.items():
    _sql = f"""WITH {A_SQL}, {offsets_sql(((0, 0, 0), *FACES))} SELECT t.i, t.j, t.k, CASE WHEN t.j % 3 <> 0 THEN {_f}(s.v) ELSE min(t.v) END AS v, t.j % 3 <> 0 AS active
        FROM a t CROSS JOIN o JOIN a s ON s.i = t.i + di AND s.j = t.j + dj AND s.k = t.k + dk GROUP BY t.i, t.j, t.k"""
    register(f"{_op}_active", _sql)(lambda spark, sf_dir, op=_op: stencil.morph_active(_stored(spark, sf_dir), op))


_KERNEL = {o: round(0.0973131 + 0.0487193 * o[0] - 0.0291787 * o[1] + 0.0193177 * o[2], 7) for o in CUBE}
_KERNEL_SQL = "w(di, dj, dk, w) AS (VALUES " + ", ".join(f"({a}, {b}, {c}, CAST({x!r} AS DOUBLE))" for (a, b, c), x in _KERNEL.items()) + ")"


@register("sparse_conv3d", f"""WITH {A_SQL}, {_KERNEL_SQL} SELECT t.i, t.j, t.k, round(sum(w * coalesce(CAST(s.v AS DOUBLE), 100.0)), 4) AS v FROM a t CROSS JOIN w
    LEFT JOIN a s ON s.i = t.i + di AND s.j = t.j + dj AND s.k = t.k + dk GROUP BY 1, 2, 3""")
def sparse_conv3d(spark, sf_dir):
    return _rounded(stencil.sparse_conv3d(lattice(spark, sf_dir, "R"), _KERNEL, 100.0), "v", places=4)


_MC = [(a, b, c, ci, co, round(0.1973137 * (ci + 1) - 0.0971719 * co + 0.0487351 * (a + 2 * b - c), 7)) for a, b, c in FACES for ci in (0, 1) for co in (0, 1, 2)]


@register("sparse_conv3d_channels", f"""WITH {A_SQL}, m(di, dj, dk, ci, co, w) AS (VALUES {", ".join(f"({a}, {b}, {c}, {ci}, {co}, CAST({w!r} AS DOUBLE))" for a, b, c, ci, co, w in _MC)}),
    f AS (SELECT i, j, k, ci, CASE ci WHEN 0 THEN CAST(v AS DOUBLE) ELSE CAST(j AS DOUBLE) END AS v FROM a CROSS JOIN (VALUES (0), (1)) x(ci))
    SELECT t.i, t.j, t.k, m.co, round(sum(m.w * s.v), 4) + 0.0 AS v FROM a t CROSS JOIN m JOIN f s ON s.ci = m.ci AND s.i = t.i + di AND s.j = t.j + dj AND s.k = t.k + dk GROUP BY 1, 2, 3, 4""")
def sparse_conv3d_channels(spark, sf_dir):
    rows = lattice(spark, sf_dir, "R").select(*IJK, F.explode(F.array(F.struct(F.lit(0).alias("ci"), F.col("v").cast("double").alias("v")), F.struct(F.lit(1).alias("ci"), F.col("j").cast("double").alias("v")))).alias("c"))
    rows = rows.select(*IJK, "c.ci", "c.v")
    kernel = spark.createDataFrame(_MC, "di int, dj int, dk int, ci int, co int, w double")
    return _rounded(stencil.sparse_conv3d_channels(rows, kernel), "v", places=4)


@register("offset_active", f"WITH {A_SQL} SELECT i, j, k, v + CAST(2.5 AS FLOAT) AS v FROM a")
def offset_active(spark, sf_dir):
    return stencil.offset_active(lattice(spark, sf_dir, "R"), 2.5)


def _curvature_sql():
    """Two steps, each a table of a cell's neighbours by offset and the closed form in their differences."""
    near = [o for o in CUBE if 0 < sum(map(abs, o)) <= 2]
    name = lambda o: "v_" + "".join("lmh"[x + 1] for x in o)
    unit = {"x": (1, 0, 0), "y": (0, 1, 0), "z": (0, 0, 1)}
    at = lambda **s: name(tuple(sum(unit[c][n] * s[c] for c in s) for n in range(3)))
    first = ", ".join(f"({at(**{c: 1})} - {at(**{c: -1})}) / 2 AS d{c}, {at(**{c: 1})} - 2 * v + {at(**{c: -1})} AS d{c}{c}" for c in "xyz")
    mixed = ", ".join(f"({at(**{p: 1, q: 1})} - {at(**{p: 1, q: -1})} - {at(**{p: -1, q: 1})} + {at(**{p: -1, q: -1})}) / 4 AS d{p}{q}" for p, q in ("xy", "xz", "yz"))
    top = "dx*dx*(dyy + dzz) + dy*dy*(dxx + dzz) + dz*dz*(dxx + dyy) - 2*(dx*dy*dxy + dx*dz*dxz + dy*dz*dyz)"
    out, last = f"WITH {DENSE_SQL}, {offsets_sql(near)}", "dense"
    for n in (1, 2):
        seen = ", ".join(f"max(CASE WHEN di = {a} AND dj = {b} AND dk = {c} THEN s.v END) AS {name((a, b, c))}" for a, b, c in near)
        out += f""", n{n} AS (SELECT t.i, t.j, t.k, t.v, {seen} FROM {last} t CROSS JOIN o JOIN {last} s ON s.i = t.i + di AND s.j = t.j + dj AND s.k = t.k + dk GROUP BY t.i, t.j, t.k, t.v),
            d{n} AS (SELECT i, j, k, v, {first}, {mixed} FROM n{n}),
            m{n} AS (SELECT i, j, k, CASE WHEN i IN (0, 10) OR j IN (0, 10) OR k IN (0, 8) OR dx*dx + dy*dy + dz*dz <= 1e-12 THEN v ELSE v + CAST(0.1 AS DOUBLE) * ({top}) / (dx*dx + dy*dy + dz*dz) END AS v FROM d{n})"""
        last = f"m{n}"
    return f"{out} SELECT i, j, k, round(v, 6) + 0.0 AS v FROM {last}"


@register("mean_curvature_flow", _curvature_sql())
def mean_curvature_flow(spark, sf_dir):
    return _rounded(stencil.mean_curvature_flow(dense(spark, sf_dir), DENSE_DIMS, 0.1, 2), "v")
