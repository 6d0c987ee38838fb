"""Text meshes and splats: OBJ and ASCII PLY, read by name and written line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_obj(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices (vid, x, y, z) and triangles (fid, v0, v1, v2) of one OBJ file; polygons become fans. Ids count from 0.

    Vertex numbers are places among the v lines. A file is read whole so that places are known: one row holds it.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "s"))
    parts = lines.select("line", F.split(F.trim("s"), r"\s+").alias("p"))
    from pyspark.sql import Window

    order = Window.orderBy("line")  # one file's lines
    v = parts.where(F.col("p")[0] == "v").select((F.row_number().over(order) - 1).alias("vid"), *(F.col("p")[n + 1].cast("double").alias(x) for n, x in enumerate("xyz")))
    f = parts.where(F.col("p")[0] == "f").select("line", F.transform(F.slice("p", 2, 1 << 20), lambda c: F.split(c, "/")[0].cast("int")).alias("c"))
    n_vertices = parts.where(F.col("p")[0] == "v").count()
    f = f.select("line", F.transform("c", lambda c: F.when(c < 0, c + n_vertices).otherwise(c - 1)).alias("c"))
    fans = f.select("line", "c", F.explode(F.sequence(F.lit(1), F.size("c") - 2)).alias("t"))
    faces = fans.select((F.row_number().over(Window.orderBy("line", "t")) - 1).alias("fid"), F.col("c")[0].alias("v0"), F.get("c", F.col("t")).alias("v1"), F.get("c", F.col("t") + 1).alias("v2"))
    return v, faces


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """place, value: the lines of an OBJ file in order (vertices by vid, then faces by fid)."""
    number = lambda c: F.format_string("%.9g", c)
    v = vertices.select(F.struct(F.lit(0).alias("part"), F.col("vid").cast("long").alias("n")).alias("place"), F.concat_ws(" ", F.lit("v"), *(number(c) for c in "xyz")).alias("value"))
    f = faces.select(F.struct(F.lit(1).alias("part"), F.col("fid").cast("long").alias("n")).alias("place"), F.concat_ws(" ", F.lit("f"), *((F.col(c) + 1).cast("string") for c in ("v0", "v1", "v2"))).alias("value"))
    return v.unionByName(f).orderBy("place")


def read_ply(spark, path: str) -> DataFrame:
    """The vertex element of an ASCII PLY file: vid and a double column for each property, by its name."""
    text = spark.read.text(path, wholetext=True)
    head = text.select(F.substring_index("value", "end_header", 1)).first()[0].split("\n")
    if not any(line.split()[:2] == ["format", "ascii"] for line in head):
        raise ValueError("only ASCII files are read")
    names, count, current = [], 0, None
    for line in head:
        p = line.split()
        if p[:1] == ["element"]:
            current = p[1]
            count = int(p[2]) if current == "vertex" else count
        elif p[:1] == ["property"] and current == "vertex":
            if p[1] == "list":
                raise ValueError("list properties of vertices are not read")
            names.append(p[-1])
    body = text.select(F.posexplode(F.split(F.regexp_replace(F.element_at(F.split("value", "end_header"), 2), r"^\s*\n", ""), "\n")).alias("vid", "s"))
    cells = body.where(F.col("vid") < count).select("vid", F.split(F.trim("s"), r"\s+").alias("p"))
    return cells.select("vid", *(F.col("p")[n].cast("double").alias(name) for n, name in enumerate(names)))


def ply_lines(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """place, value: an ASCII PLY file of one vertex per row, by key, its header first."""
    count = rows.count()
    head = ["ply", "format ascii 1.0", f"element vertex {count}", *(f"property float {n}" for n in names), "end_header"]
    top = rows.sparkSession.createDataFrame([(0, n, line) for n, line in enumerate(head)], "part int, n long, value string")
    made: list[Column] = [F.format_string("%.9g", F.col(n).cast("double")) for n in names]
    body = rows.select(F.lit(1).alias("part"), F.col(key).cast("long").alias("n"), F.concat_ws(" ", *made).alias("value"))
    return top.unionByName(body).select(F.struct("part", "n").alias("place"), "value").orderBy("place")
