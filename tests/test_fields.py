"""Operators that SQL cannot express, against brute force on small grids."""

import math
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.model import CUBE, FACES, NEAR26, box
from lattica.operators import combine, index, levelset, mesh, pde, sampling, splats, stencil


def grid(spark, values):
    rows = [(int(i), int(j), int(k), float(v)) for (i, j, k), v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, "i int, j int, k int, v double")


def array(df, dims, column="v"):
    out = np.full(dims, np.nan)
    for r in df.collect():
        out[r["i"], r["j"], r["k"]] = r[column]
    return out


def components(cells, offsets):
    left, out = set(cells), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            c = todo.pop()
            own.add(c)
            for o in offsets:
                n = tuple(a + b for a, b in zip(c, o))
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(own)
    return out


@pytest.mark.parametrize("connectivity,offsets", [(6, FACES), (26, NEAR26)])
def test_segmentation(spark, connectivity, offsets):
    r = np.random.default_rng(3)
    cells = {tuple(int(x) for x in c) for c in r.integers(-3, 5, (90, 3))}
    df = spark.createDataFrame(sorted(cells), "i int, j int, k int")
    got = defaultdict(set)
    for row in levelset.first_cells(levelset.segmentation(df, connectivity)).collect():
        got[row["label_k"], row["label_j"], row["label_i"]].add((row["i"], row["j"], row["k"]))
    want = {min((k, j, i) for i, j, k in own): own for own in components(cells, offsets)}
    assert dict(got) == want


def test_segmentation_of_nothing(spark):
    assert levelset.segmentation(spark.createDataFrame([], "i int, j int, k int")).count() == 0


def test_enclosed_regions_and_flood_fill(spark):
    v = np.ones((6, 6, 6))
    v[1:5, 1:5, 1:5] = -1
    v[2:4, 2:4, 2:4] = 1
    df = grid(spark, v)
    found = {(r["i"], r["j"], r["k"]) for r in levelset.enclosed_regions(df, v.shape).collect()}
    assert found == set(product((2, 3), repeat=3))
    filled = array(levelset.signed_flood_fill(df.selectExpr("i", "j", "k", "case when v > 0 then 5.0 else 0.5 end v"), v.shape, 2.0), v.shape)
    assert filled[0, 0, 0] == 2.0 and filled[2, 2, 2] == -2.0 and filled[1, 1, 1] == 0.5


def test_genus_of_a_ring_and_a_ball(spark):
    ring = [(a, b, 0) for a, b in product(range(3), repeat=2) if (a, b) != (1, 1)]
    assert levelset.genus(spark.createDataFrame(ring, "i int, j int, k int")).first()["genus"] == 1
    ball = list(product(range(3), repeat=3))
    assert levelset.genus(spark.createDataFrame(ball, "i int, j int, k int")).first()["genus"] == 0


def test_fast_sweeping_of_a_plane(spark):
    v = np.broadcast_to((np.arange(9) - 3.3)[:, None, None], (9, 3, 3)).copy()
    start = np.where(np.abs(v) <= 1, v, np.sign(v) * 50)
    got = array(levelset.fast_sweeping(grid(spark, start), v.shape, 1.0), v.shape)
    assert np.allclose(got, v)


def test_poisson_solves_its_own_equation(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((4, 3, 3))
    u = array(pde.solve_poisson(grid(spark, v), 1.0, 1e-10, 80), v.shape, "u")
    padded = np.pad(u, 1, mode="edge")
    around = sum(padded[1 + a : 5 + a, 1 + b : 4 + b, 1 + c : 4 + c] for a, b, c in FACES)
    assert np.allclose(6 * u - around, v - v.mean(), atol=1e-6)


def test_mean_curvature_flow_shrinks_a_sphere(spark):
    p = np.stack(np.meshgrid(*[np.arange(9) - 4.0] * 3, indexing="ij"))
    v = np.sqrt((p**2).sum(axis=0)) - 3
    got = array(stencil.mean_curvature_flow(grid(spark, v), v.shape, 0.1), v.shape)
    # A sphere's distance field has curvature 2 / r, so values rise by 0.1 * 2 / r.
    assert got[4, 4, 7] - v[4, 4, 7] == pytest.approx(0.1 * 2 / 3, rel=0.1)
    assert np.array_equal(got[0], v[0])


def test_morphology_by_brute_force(spark):
    r = np.random.default_rng(5)
    v = r.standard_normal((4, 5, 3))
    padded = np.pad(v, 1, mode="edge")
    taps = np.stack([padded[1 + a : 5 + a, 1 + b : 6 + b, 1 + c : 4 + c] for a, b, c in ((0, 0, 0), *FACES)])
    assert np.allclose(array(stencil.morph(grid(spark, v), v.shape, "dilate"), v.shape), taps.min(axis=0))
    assert np.allclose(array(stencil.morph(grid(spark, v), v.shape, "erode"), v.shape), taps.max(axis=0))
    wide = np.stack([padded[1 + a : 5 + a, 1 + b : 6 + b, 1 + c : 4 + c] for a, b, c in CUBE])
    assert np.allclose(array(stencil.median_filter(grid(spark, v), v.shape), v.shape), np.median(wide, axis=0))


def test_csg_with_nan_and_missing_sides(spark):
    a = spark.createDataFrame([(0, 0, 0, float("nan")), (1, 0, 0, 1.0)], "i int, j int, k int, v double")
    b = spark.createDataFrame([(0, 0, 0, 2.0), (2, 0, 0, -3.0)], "i int, j int, k int, v double")
    got = {r["i"]: r["v"] for r in combine.csg_sparse(a, b, "union", 9.0).collect()}
    assert got == {0: 2.0, 1: 1.0, 2: -3.0}


def test_morton_covers_negative_coordinates(spark):
    cells = spark.createDataFrame([(-1048576, 0, 5), (1048575, -7, -1), (3, 2, 1)], "i int, j int, k int")
    code = cells.select("*", index.morton_encode(cells.i, cells.j, cells.k).alias("code"))
    back = code.select("i", "j", "k", *[c.alias(f"b{n}") for n, c in enumerate(index.morton_decode(code.code))])
    assert all((r["i"], r["j"], r["k"]) == (r["b0"], r["b1"], r["b2"]) for r in back.collect())


def test_first_duplicate_wins(spark):
    rows = spark.createDataFrame([(0, 0, 0, 5.0, 2), (0, 0, 0, 7.0, 1)], "i int, j int, k int, v double, ord int")
    assert combine.first_wins(rows, ["ord"]).first()["v"] == 7.0


def rays(spark, rows):
    return spark.createDataFrame(rows, "ray_id int, ox double, oy double, oz double, dx double, dy double, dz double, tmin double, tmax double")


def test_voxels_along_ray(spark):
    r = np.random.default_rng(2)
    rows = [(n, *map(float, r.uniform(0.1, 4.9, 3)), *map(float, r.uniform(-1, 1, 3)), 0.0, 6.0) for n in range(8)]
    got = defaultdict(set)
    for x in sampling.voxels_along_ray(rays(spark, rows), (5, 5, 5)).collect():
        got[x["ray_id"]].add((x["i"], x["j"], x["k"]))
    for n, *o in rows:
        t = np.linspace(0, 6, 60001)[:, None]
        p = np.floor(np.array(o[:3]) + t * np.array(o[3:6])).astype(int)
        dense = {tuple(map(int, c)) for c in p if (c >= 0).all() and (c < 5).all()}
        assert dense <= got[n] and len(got[n] - dense) <= 1


def test_voxels_of_stretches_as_short_as_rounding(spark):
    # Rays through lattice edges: the planes of two axes are crossed at times that rounding alone tells apart.
    rows = [(n, float(n % 11), (n * 37 % 1099 - 100) / 100, -1.5, 0.3 - (n % 7) / 10, 0.2, 1.0, 0.0, 11.0) for n in range(1, 500)]
    rows += [(500, -3.0, 0.1, 0.1, 1.0, 0.0, 0.3, 0.0, 11.0), (501, 5.0, 5.0, 5.0, 1.0, 1.0, 1.0, 3.0, 3.0), (502, 5.0, 5.0, 5.0, 1.0, 1.0, 1.0, 4.0, 3.0)]
    dims = (11, 11, 9)
    want = set()
    cells = np.stack(np.meshgrid(*map(np.arange, dims), indexing="ij"), -1).reshape(-1, 3)
    for n, *r in rows:
        low, high = np.full(len(cells), r[6]), np.full(len(cells), r[7])
        for c in range(3):
            at, along = r[c], r[3 + c]
            if abs(along) <= 1e-12:
                high[np.floor(at) != cells[:, c]] = -1e9
                continue
            ends = (cells[:, c] - at) / along, (cells[:, c] + 1 - at) / along
            low, high = np.maximum(low, np.minimum(*ends)), np.minimum(high, np.maximum(*ends))
        want |= {(n, *map(int, c)) for c in cells[low < high]}
    got = [tuple(r) for r in sampling.voxels_along_ray(rays(spark, rows), dims).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_segments_and_casts(spark):
    v = np.broadcast_to(np.abs(np.arange(12) - 5.5)[:, None, None] - 2.25, (12, 3, 3)).copy()
    df = grid(spark, v)
    line = rays(spark, [(1, 0.0, 1.5, 1.5, 1.0, 0.0, 0.0, 0.0, 12.0), (2, 0.0, 1.5, 1.5, 1.0, 0.0, 0.0, 4.5, 5.0)])
    got = {(r["ray_id"], r["run"]): (r["t_in"], r["t_out"]) for r in sampling.segments_along_ray(line, df, v.shape, 97).collect()}
    assert got[1, 0] == pytest.approx((3.75, 8.25))
    assert got[2, 0] == pytest.approx((4.5, 5.0))
    assert {r["ray_id"]: r["t"] for r in sampling.ray_cast(line, df, v.shape, 97).collect()}[1] == pytest.approx(3.75)


def test_volume_render_of_uniform_fog(spark):
    df = grid(spark, np.full((6, 6, 6), 0.5))
    got = sampling.volume_render(rays(spark, [(1, 3.0, 3.0, 0.0, 0.0, 0.0, 1.0, 0.0, 6.0)]), df, (6, 6, 6), 24, 0.4, 0.25).first()["pixel"]
    through = math.exp(-0.5 * 0.4 * 6)
    assert got == pytest.approx(1 - through + 0.25 * through)


@pytest.mark.parametrize("order,scheme", [(1, "plain"), (2, "plain"), (3, "plain"), (4, "plain"), (2, "maccormack"), (2, "bfecc")])
def test_advection_moves_a_ramp(spark, order, scheme):
    v = np.broadcast_to(np.arange(8.0)[:, None, None], (8, 2, 2)).copy()
    wind = box(spark, v.shape).selectExpr("i", "j", "k", "double(1) x", "double(0) y", "double(0) z")
    got = array(sampling.advect(grid(spark, v), v.shape, wind, 0.5, order, scheme), v.shape)
    assert np.allclose(got[2:-1], v[2:-1] - 0.5)


def test_higher_orders_follow_a_turning_wind_more_closely(spark):
    n = 9
    p = np.stack(np.meshgrid(np.arange(n) + 0.5, np.arange(n) + 0.5, [0.5], indexing="ij")) - n / 2
    v = p[0] + 0 * p[1]
    wind = box(spark, v.shape).selectExpr("i", "j", "k", f"-(j + 0.5 - {n / 2}) x", f"i + 0.5 - {n / 2} y", "double(0) z")
    want = math.cos(0.6) * p[0] + math.sin(0.6) * p[1]
    error = [np.abs(array(sampling.advect(grid(spark, v), v.shape, wind, 0.6, order), v.shape) - want)[3:6, 3:6].max() for order in (1, 2, 4)]
    assert error[0] > error[1] > error[2] and error[2] < 0.01


def test_spheres_of_a_ball(spark):
    p = np.stack(np.meshgrid(*[np.arange(9) - 4.0] * 3, indexing="ij"))
    v = np.sqrt((p**2).sum(axis=0)) - 3
    got = sampling.volume_to_spheres(grid(spark, v), 5, 0.0).orderBy("n").collect()
    assert (got[0]["x"], got[0]["y"], got[0]["z"], got[0]["r"]) == (4.5, 4.5, 4.5, 3.0)
    assert all((r["x"] - 4.5) ** 2 + (r["y"] - 4.5) ** 2 + (r["z"] - 4.5) ** 2 >= 9 for r in got[1:])


def octahedron(spark):
    rows = []
    for n, (x, y, z) in enumerate(product((-1.0, 1.0), repeat=3)):
        a, b, c = (2 * x, 0.0, 0.0), (0.0, 2 * y, 0.0), (0.0, 0.0, 2 * z)
        if x * y * z < 0:
            b, c = c, b
        rows.append((n, *a, *b, *c))
    return spark.createDataFrame(rows, "fid int, " + ", ".join(f"{p}{x} double" for p in "abc" for x in "xyz"))


def test_winding_and_signed_distance(spark):
    solid = octahedron(spark)
    points = spark.createDataFrame([(1, 0.1, 0.2, 0.1), (2, 3.0, 0.0, 0.0), (3, -0.5, 0.5, -0.3)], "pid int, x double, y double, z double")
    got = {r["pid"]: r["winding"] for r in mesh.winding(points, "pid", solid).collect()}
    assert abs(got[1]) == pytest.approx(1) and abs(got[3]) == pytest.approx(1) and got[2] == pytest.approx(0, abs=1e-9)
    near = {r["pid"]: r["distance"] for r in mesh.closest_triangle(points, "pid", solid, 2.5).collect()}
    assert near[1] == pytest.approx((2 - 0.4) / math.sqrt(3)) and near[2] == pytest.approx(1.0)


def test_closest_triangle_by_brute_force_in_slices(spark, monkeypatch):
    r = np.random.default_rng(8)
    corners = (r.uniform(0, 4, (300, 1, 3)) + r.uniform(-0.4, 0.4, (300, 3, 3))).round(2)
    corners[200:] = corners[:100]  # the same triangles again, by higher numbers
    corners[100:110, 1] = corners[100:110, 0]  # no area
    p = r.uniform(-1, 5, (400, 3)).round(2)
    names = [f"{c}{x}" for c in "abc" for x in "xyz"]
    soup = spark.createDataFrame([(n, *map(float, t.ravel())) for n, t in enumerate(corners)] + [(-1, *[None] * 9)], "fid int, " + ", ".join(f"{c} double" for c in names))
    points = spark.createDataFrame([(n, *map(float, x)) for n, x in enumerate(p)] + [(-1, None, 0.0, 0.0)], "pid int, x double, y double, z double")
    near = np.stack([mesh.point_triangle_distance(list(p.T), list(t.ravel())) for t in corners], axis=1)
    want = {n: (int(d.argmin()), float(d.min())) for n, d in enumerate(near) if d.min() <= 0.5}
    assert 100 < len(want) < 400
    got = {}
    for size in (20_000, 7):
        monkeypatch.setattr(mesh, "SLICE", size)
        got[size] = {r["pid"]: (r["fid"], r["distance"]) for r in mesh.closest_triangle(points, "pid", soup, 0.5).collect()}
        assert got[size] == want
    whole = mesh.closest_triangle(points.select(F.struct("pid").alias("pid"), "x", "y", "z"), "pid", soup.select(F.struct("fid").alias("fid"), *names), 0.5)
    assert {r["pid"]["pid"]: (r["fid"]["fid"], r["distance"]) for r in whole.collect()} == want
    d2 = points.crossJoin(soup).where("pid < 20 and pid >= 0 and fid >= 0").select("pid", "fid", mesh.point_triangle_distance2().alias("d"))
    assert all(near[r["pid"], r["fid"]] == math.sqrt(r["d"]) for r in d2.collect())


def test_closest_triangle_has_no_method_that_is_never_compiled(spark):
    # HotSpot leaves methods above 8,000 bytes to its interpreter: most of the time at 0.1 of the tables went there.
    names = [f"{c}{x}" for c in "abc" for x in "xyz"]
    found = mesh.closest_triangle(spark.range(9).selectExpr("id", "id + 0.5D x", "0.5D y", "0.5D z"), "id", spark.range(9).selectExpr("id fid", *(f"id * 0.9D {c}" for c in names)), 1.5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq(found._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(stages.apply(n)._3().maxMethodCodeSize()) for n in range(stages.size())]
    assert sizes and max(sizes) < 8000


def test_surface_is_closed_and_faces_outwards(spark):
    p = np.stack(np.meshgrid(*[np.arange(8) - 3.4] * 3, indexing="ij"))
    v = np.sqrt((p**2).sum(axis=0)) - 2.5
    rows = [r.asDict() for r in mesh.surface_triangles(grid(spark, v), v.shape).collect()]
    corner = lambda r, n: tuple(round(r[f"{n}{x}"], 9) for x in "xyz")
    used = defaultdict(int)
    volume = 0.0
    for r in rows:
        t = [corner(r, n) for n in "abc"]
        volume += np.dot(t[0], np.cross(t[1], t[2])) / 6
        for a, b in ((0, 1), (1, 2), (2, 0)):
            if t[a] != t[b]:
                used[t[a], t[b]] += 1
    assert all(used[b, a] == n for (a, b), n in list(used.items()))
    assert volume == pytest.approx(4 / 3 * math.pi * 2.5**3, rel=0.1)


def test_regular_tetrahedron_quality(spark):
    row = (0, 1.0, 1.0, 1.0, 1.0, -1.0, -1.0, -1.0, 1.0, -1.0, -1.0, -1.0, 1.0)
    tets = spark.createDataFrame([row], "tid int, " + ", ".join(f"{p}{x} double" for p in "abcd" for x in "xyz"))
    got = mesh.tet_quality(tets).first()
    assert got["least"] == pytest.approx(math.degrees(math.acos(1 / 3))) and got["largest"] == pytest.approx(got["least"])


def test_splat_projection_of_a_round_splat(spark):
    row = (1, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)
    s = spark.createDataFrame([row], "sid int, x double, y double, z double, qx double, qy double, qz double, qw double, sx double, sy double, sz double, logit double")
    got = splats.project(s, splats.perspective(8.0, 8.0, 5.0, 6.0)).first()
    assert (got["u"], got["v"], got["depth"], got["opacity"]) == (5.0, 6.0, 4.0, 0.5)
    assert got["ca"] == pytest.approx(1 / 4.3) and got["cb"] == pytest.approx(0)
    colors = spark.createDataFrame([(1, 1.0, 0.5, 0.0)], "sid int, r double, g double, b double")
    image = {(r["px"], r["py"]): r for r in splats.rasterize(splats.project(s, splats.perspective(8.0, 8.0, 5.0, 6.0)), colors, 12, 12).collect()}
    assert image[5, 6]["r"] == pytest.approx(0.5) and image[5, 6]["through"] == pytest.approx(0.5)
    assert image[6, 6]["g"] == pytest.approx(0.25 * math.exp(-0.5 / 4.3))


def test_splat_gradient_is_that_of_the_picture(spark):
    r = np.random.default_rng(4)
    names = ["u", "v", "ca", "cb", "cc", "opacity"]
    rows = [(n, *r.uniform(3, 9, 2), float(n // 2), 0.2, 0.05, 0.3, 30.0, *r.uniform(0.3, 0.9, 4)) for n in range(6)]
    layout = ["sid", "u", "v", "depth", "ca", "cb", "cc", "radius", "opacity", "r", "g", "b"]
    rows[3] = (*rows[3][:8], 1.0, *rows[3][9:])  # one that hides what is behind it, and ties in depth
    ask = [(x, y, *r.uniform(-1, 1, 4)) for x in range(12) for y in range(12)]
    grads = spark.createDataFrame([(x, y, *map(float, g)) for x, y, *g in ask], "px int, py int, gr double, gg double, gb double, ga double")

    def picture(values):
        total = 0.0
        for x, y, gr, gg, gb, ga in ask:
            through, seen = 1.0, np.zeros(3)
            for s in sorted(values, key=lambda s: (s["depth"], s["sid"])):
                dx, dy = x - s["u"], y - s["v"]
                power = 0.5 * (s["ca"] * dx * dx + s["cc"] * dy * dy) + s["cb"] * dx * dy
                alpha = s["opacity"] * math.exp(-power) if power <= 10 else 0
                if alpha >= 1e-9 and through >= 0.001:
                    seen += through * alpha * np.array([s["r"], s["g"], s["b"]])
                    through *= 1 - alpha
            total += (seen + through * np.array([0.1, 0.2, 0.3])) @ [gr, gg, gb] + (1 - through) * ga
        return total

    base = [dict(zip(layout, map(float, row))) for row in rows]
    df = spark.createDataFrame([(int(a), *map(float, rest)) for a, *rest in rows], "sid int, " + ", ".join(f"{c} double" for c in layout[1:]))
    projected, colors = df.drop("r", "g", "b"), df.select("sid", "r", "g", "b")
    got = {x["sid"]: x for x in splats.rasterize_vjp(projected, colors, grads, 12, 12, threshold=1e-9, background=(0.1, 0.2, 0.3)).collect()}
    for n in range(6):
        for c in [*names, "r", "g", "b"]:
            ends = [picture([{**s, c: s[c] + (step if s["sid"] == n else 0)} for s in base]) for step in (-1e-6, 1e-6)]
            assert got[n][f"g{c}"] == pytest.approx((ends[1] - ends[0]) / 2e-6, rel=1e-3, abs=1e-4), (n, c)
    image = {(x["px"], x["py"]): x for x in splats.rasterize(projected, colors, 12, 12, threshold=1e-9, background=(0.1, 0.2, 0.3)).collect()}
    assert len(image) == 144
    assert sum(image[x, y]["r"] * gr + image[x, y]["g"] * gg + image[x, y]["b"] * gb + (1 - image[x, y]["through"]) * ga for x, y, gr, gg, gb, ga in ask) == pytest.approx(picture(base))


def test_cameras_move_and_cut(spark):
    row = (1, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)
    s = spark.createDataFrame([row], "sid int, x double, y double, z double, qx double, qy double, qz double, qw double, sx double, sy double, sz double, logit double")
    moved = (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, -1, 0, 1, 1)
    got = splats.project(s, splats.perspective(8.0, 8.0, 5.0, 6.0, extrinsics=moved)).first()
    assert (got["u"], got["v"], got["depth"]) == (5.0, 10.0, 4.0)
    assert splats.project(s, splats.perspective(8.0, 8.0, 5.0, 6.0, far=3.0)).count() == 0
    assert splats.orthographic(0.5, 5.0, 6.0, 16, 32).fy == 16.0


def test_rebuilt_band_holds_distances_on_full_and_sparse_fields(spark):
    cells = np.array(list(product(range(16), repeat=3)), float)
    true = np.linalg.norm(cells + 0.5 - 8, axis=1) - 4.2
    damaged = 3 * true + 0.2 * true**3 + 0.7
    field = grid(spark, damaged.reshape(16, 16, 16))
    want = {tuple(map(int, c)): d for c, d in zip(cells, true, strict=True)}
    exact = {c for c, d in want.items() if -1.4 < d < 1.9}
    for voxels in (field, field.where("abs(v - 0.7) < 5")):  # the second holds less than the band that is asked for
        got = {(r["i"], r["j"], r["k"]): r["v"] for r in mesh.level_set_rebuild(voxels, 2.0, 1.5, 0.7).collect()}
        assert exact <= set(got) and all(-1.5 < v < 2.0 for v in got.values())
        assert max(abs(v - want[c]) for c, v in got.items()) < 0.1  # a flat cut of a cell's diagonal is off by up to 3 / (8 * 4.2)
    again = {(r["i"], r["j"], r["k"]): r["v"] for r in mesh.level_set_track(field.selectExpr("i", "j", "k", "v - 0.7 as v"), 2.0, 1.5).collect()}
    assert again.keys() >= exact and mesh.level_set_rebuild(field.where("v > 1e9"), 2.0, 1.5).count() == 0


def test_level_set_of_an_inside_out_mesh(spark):
    tips = [(0.0, 0.0, 0.0), (3.0, 0.0, 0.0), (0.0, 3.0, 0.0), (0.0, 0.0, 3.0)]
    faces = [(0, 1, 2), (0, 3, 1), (0, 2, 3), (1, 3, 2)]
    layout = "fid int, " + ", ".join(f"{p}{x} double" for p in "abc" for x in "xyz")
    both = []
    for turn in (1, -1):
        rows = [(n, *(c for v in f[::turn] for c in tips[v])) for n, f in enumerate(faces)]
        both.append({(r["i"], r["j"], r["k"]): r["v"] for r in mesh.mesh_to_level_set(spark.createDataFrame(rows, layout), 0.35, 1.0, 1.0).collect()})
    assert both[0].keys() == both[1].keys() and all(both[1][c] == pytest.approx(v) for c, v in both[0].items())
    assert both[0][2, 2, 2] == pytest.approx(-(3 - 3 * 0.7) / math.sqrt(3)) and both[0][-1, 1, 1] == pytest.approx(0.35)
    assert mesh.mesh_to_level_set(spark.createDataFrame([], layout), 0.35, 1.0, 1.0).count() == 0
