from lattica.model import box
from lattica.operators.sampling import integrate_tsdf
from lattica.streaming import Fusion

FRAME = {"fx": 6.0, "fy": 6.0, "cx": 4.0, "cy": 4.0, "width": 8, "height": 8, "pose": [1.0, 0, 0, 2.0, 0, 1.0, 0, 2.0, 0, 0, 1.0, -3.0], "trunc": 1.5, "dmin": 0.1, "dmax": 9.0}


def test_stream_fuses_as_frames_one_by_one(spark, tmp_path):
    voxels = box(spark, (4, 4, 4)).selectExpr("i", "j", "k", "double(0) v", "double(0) w")
    rows = [(f, u, v, 3.0 + 0.1 * u + 0.5 * f) for f in (1, 2) for u in range(8) for v in range(8)]
    for f in (1, 2):
        spark.createDataFrame([r for r in rows if r[0] == f], "frame_id int, u int, v int, depth double").coalesce(1).write.parquet(str(tmp_path / f"in/f{f}"))
    stream = spark.readStream.schema("frame_id int, u int, v int, depth double").parquet(str(tmp_path / "in/*"))
    fusion = Fusion(voxels, str(tmp_path / "grid"), {1: FRAME, 2: FRAME}, 1.0)
    fusion.start(stream, str(tmp_path / "checkpoint")).awaitTermination(120)
    want = voxels
    for f in (1, 2):
        want = integrate_tsdf(want, spark.createDataFrame([r for r in rows if r[0] == f], "frame_id int, u int, v int, depth double"), FRAME, 1.0)
    key = lambda df: sorted((r["i"], r["j"], r["k"], round(r["v"], 9), r["w"]) for r in df.collect())
    assert key(fusion.version()) == key(want) and any(r["w"] == 2 for r in want.collect())


def test_a_new_driver_goes_on_where_the_last_one_stopped(spark, tmp_path):
    voxels = box(spark, (4, 4, 4)).selectExpr("i", "j", "k", "double(0) v", "double(0) w")
    frame = lambda f: spark.createDataFrame([(f, u, v, 3.0 + 0.1 * u + 0.5 * f) for u in range(8) for v in range(8)], "frame_id int, u int, v int, depth double")
    schema, where, held = "frame_id int, u int, v int, depth double", str(tmp_path / "grid"), str(tmp_path / "checkpoint")
    for f in (1, 2):
        frame(f).coalesce(1).write.parquet(str(tmp_path / f"in/f{f}"))
        fusion = Fusion(voxels, where, {1: FRAME, 2: FRAME}, 1.0)  # as after a restart: nothing but the folders is left
        fusion.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in/*")), held).awaitTermination(120)
    want = integrate_tsdf(integrate_tsdf(voxels, frame(1), FRAME, 1.0), frame(2), FRAME, 1.0)
    key = lambda df: sorted((r["i"], r["j"], r["k"], round(r["v"], 9), r["w"]) for r in df.collect())
    assert key(Fusion(voxels, where, {1: FRAME, 2: FRAME}, 1.0).version()) == key(want) and any(r["w"] == 2 for r in want.collect())
