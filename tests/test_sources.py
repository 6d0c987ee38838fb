import numpy as np
import pytest

from lattica.sources import meshes, vdb


@pytest.mark.parametrize("zipped", [True, False])
def test_volume_file_round_trip(zipped):
    r = np.random.default_rng(1)
    ijk = np.unique(r.integers(-5000, 5000, (400, 3)), axis=0)
    values = r.standard_normal(len(ijk)).astype(np.float32)
    (grid,) = vdb.read_grids(vdb.write_grid("g", ijk, values, 0.5, 0.25, zipped))
    assert grid["name"] == "g" and grid["background"] == 0.5 and grid["matrix"][0] == 0.25 and grid["metadata"]["name"] == "g"
    got = {}
    for origin, v, mask in grid["leaves"]:
        for n in np.flatnonzero(mask):
            got[origin[0] + (n >> 6), origin[1] + (n >> 3 & 7), origin[2] + (n & 7)] = v[n]
        assert (v[~mask] == 0.5).all()
    assert got == {tuple(c): v for c, v in zip(ijk.tolist(), values, strict=True)}


def test_volume_source_and_sink(spark, tmp_path):
    rows = [("a", 1, 2, 3, 1.5), ("a", -9, 0, 4096, -2.0), ("b", 0, 0, 0, 7.0), ("b", 0, 0, 0, 8.0)]
    df = spark.createDataFrame(rows, "grid string, i int, j int, k int, v float").coalesce(1)
    for r in vdb.vdb_files(df).collect():
        (tmp_path / f"{r['grid']}.vdb").write_bytes(r["content"])
    back = {(r["grid"], r["i"], r["j"], r["k"]): r["v"] for r in vdb.read_vdb(spark, str(tmp_path)).collect()}
    assert back == {("a", 1, 2, 3): 1.5, ("a", -9, 0, 4096): -2.0, ("b", 0, 0, 0): 7.0}
    assert {r["grid"]: r["type"] for r in vdb.read_vdb_grids(spark, str(tmp_path)).collect()} == {"a": vdb.TREE, "b": vdb.TREE}


@pytest.mark.parametrize("half", [False, True])
@pytest.mark.parametrize("kind", list(vdb.KINDS))
def test_values_of_every_kind(kind, half):
    r = np.random.default_rng(2)
    ijk = np.unique(r.integers(-300, 300, (60, 3)), axis=0)
    number = np.dtype(vdb.KINDS[kind])
    values = r.integers(-1000, 1000, (len(ijk), *number.shape)).astype(number.base)
    if number.base.kind == "i" and number.base.itemsize == 8:
        values += 1 << 60  # more than a double holds
    data = vdb.write_grid("g", ijk, values, 7, 0.5, kind=kind, half=half, metadata={"class": "staggered", "n": 3, "at": (1.5, 2.0, 3.0), "on": True, "name": "other"})
    (grid,) = vdb.read_grids(data)
    assert grid["type"] == vdb.tree_name(kind, half) and (np.asarray(grid["background"]) == 7).all()
    assert grid["metadata"]["class"] == "staggered" and grid["metadata"]["n"] == "3" and grid["metadata"]["at"] == "1.5 2.0 3.0" and grid["metadata"]["on"] == "True"
    got = {(origin[0] + (n >> 6), origin[1] + (n >> 3 & 7), origin[2] + (n & 7)): np.asarray(v[n]).tolist() for origin, v, mask in grid["leaves"] for n in np.flatnonzero(mask)}
    assert got == {tuple(c): v.tolist() for c, v in zip(ijk.tolist(), values, strict=True)}


def test_kinds_of_one_folder_are_read_one_by_one(spark, tmp_path):
    vectors = spark.createDataFrame([("w", 1, 2, 3, 0.5, -1.0, 2.0), ("w", 9, 2, 3, 1.0, 1.0, 1.0)], "grid string, i int, j int, k int, x float, y float, z float")
    longs = spark.createDataFrame([("n", 5, 5, 5, (1 << 60) + 1)], "grid string, i int, j int, k int, v long")
    for r in vdb.vdb_files(vectors, kind="vec3s", half=True).union(vdb.vdb_files(longs, kind="int64")).collect():
        (tmp_path / f"{r['grid']}.vdb").write_bytes(r["content"])
    got = {tuple(r)[2:] for r in vdb.read_vdb(spark, str(tmp_path), kind="vec3s").drop("path").select("grid", "span", "i", "j", "k", "x", "y", "z").collect()}
    assert got == {(1, 2, 3, 0.5, -1.0, 2.0), (9, 2, 3, 1.0, 1.0, 1.0)}
    assert [(r["i"], r["v"]) for r in vdb.read_vdb(spark, str(tmp_path), kind="int64").collect()] == [(5, (1 << 60) + 1)]
    assert vdb.read_vdb(spark, str(tmp_path), kind="double").count() == 0
    assert {r["type"] for r in vdb.read_vdb_grids(spark, str(tmp_path)).collect()} == {vdb.tree_name("vec3s", True), vdb.tree_name("int64")}
    with pytest.raises(Exception, match="ask for its kind"):
        vdb.read_vdb(spark, str(tmp_path)).count()


def test_broken_volume_file():
    data = vdb.write_grid("g", np.zeros((1, 3)), np.ones(1))
    with pytest.raises(ValueError):
        list(vdb.read_grids(b"x" * 100))
    with pytest.raises(Exception):
        list(vdb.read_grids(data[:-300]))


def test_obj_and_ply(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# x\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0.5\nf 1 2 3 4\nf -4/1 -3/2 -1/3\n")
    v, f = meshes.read_obj(spark, str(tmp_path / "m.obj"))
    assert [tuple(r)[1:] for r in f.orderBy("fid").collect()] == [(0, 1, 2), (0, 2, 3), (0, 1, 3)] and v.count() == 4
    lines = [r["value"] for r in meshes.obj_lines(v, f).collect()]
    assert lines[3] == "v 0.00000 1.00000 0.500000" or lines[3].split()[0] == "v" and lines[4] == "f 1 2 3"
    s = spark.createDataFrame([(0, 1.5, 2.0), (1, -1.0, 0.25)], "id int, x double, opacity double")
    (tmp_path / "s.ply").write_text("\n".join(r["value"] for r in meshes.ply_lines(s, "id", ["x", "opacity"]).collect()) + "\n")
    assert [tuple(r) for r in meshes.read_ply(spark, str(tmp_path / "s.ply")).orderBy("vid").collect()] == [(0, 1.5, 2.0), (1, -1.0, 0.25)]
