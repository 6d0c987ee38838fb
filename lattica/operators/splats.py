"""Gaussian splats: spherical harmonics, cameras, projection, ordered blending and its gradient, relocation and noise."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The real spherical-harmonic factors of degrees 0 to 3.
SH0 = 0.28209479177387814
SH1 = 0.4886025119029199
SH2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
SH3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)

#: Fixed value: the largest number of copies that relocation counts with.
MOST_COPIES = 51


def sh_basis(x: Column, y: Column, z: Column, degree: int) -> list[Column]:
    """The (degree + 1)^2 basis values of a unit direction."""
    xx, yy, zz = x * x, y * y, z * z
    by_degree = [
        [F.lit(SH0)],
        [f * c for f, c in zip((-SH1, SH1, -SH1), (y, z, x), strict=True)],
        [f * c for f, c in zip(SH2, (x * y, y * z, 2 * zz - xx - yy, x * z, xx - yy), strict=True)],
        [f * c for f, c in zip(SH3, (
            y * (3 * xx - yy), x * y * z, y * (4 * zz - xx - yy), z * (2 * zz - 3 * xx - 3 * yy), x * (4 * zz - xx - yy), z * (xx - yy), x * (xx - 3 * yy),
        ), strict=True)],
    ]
    return [b for part in by_degree[: degree + 1] for b in part]


def sh_eval(rows: DataFrame, key: str, coefficients: str, direction: tuple, degree: int = 2) -> DataFrame:
    """key, r, g, b: a half is added and the sum held above 0.

    coefficients: an array, for each basis function its three colours. direction: three numbers or three column names; a
    direction without length leaves the constant term alone.
    """
    if not 0 <= degree <= 3:
        raise ValueError("degrees 0 to 3")
    way = [F.col(d).cast("double") if isinstance(d, str) else F.lit(float(d)) for d in direction]
    size = F.sqrt(way[0] * way[0] + way[1] * way[1] + way[2] * way[2])
    unit = [F.when(size > 1e-8, d / size).otherwise(0.0).alias(f"_{n}") for n, d in zip("xyz", way, strict=True)]
    basis = F.array(*sh_basis(F.col("_x"), F.col("_y"), F.col("_z"), degree)).alias("_basis")
    held = rows.select(key, F.col(coefficients).alias("_c"), *unit).select(key, "_c", basis)

    def colour(c: int) -> Column:
        total = F.lit(0.5)
        for n in range((degree + 1) ** 2):
            total = total + F.col("_basis")[n] * F.col("_c")[3 * n + c].cast("double")
        return F.greatest(total, F.lit(0.0))

    return held.select(key, *(colour(c).alias(name) for c, name in enumerate("rgb")))


@dataclass(frozen=True)
class Camera:
    """A pinhole: focal lengths, middle, depths that are seen, and 16 numbers by column that take the world to the camera."""

    fx: float
    fy: float
    cx: float
    cy: float
    near: float = 0.01
    far: float = math.inf
    extrinsics: tuple[float, ...] = (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)


def perspective(fx: float, fy: float, cx: float, cy: float, near: float = 0.01, far: float = math.inf, extrinsics=Camera.extrinsics) -> Camera:
    return Camera(fx, fy, cx, cy, near, far, tuple(extrinsics))


def orthographic(scale: float, cx: float, cy: float, width: float, height: float, near: float = 0.01, far: float = math.inf, extrinsics=Camera.extrinsics) -> Camera:
    """Focal lengths from the picture's size; projection divides by depth for this camera too."""
    return Camera(scale * width, scale * height, cx, cy, near, far, tuple(extrinsics))


def project(splats: DataFrame, camera: Camera) -> DataFrame:
    """splats: sid, x, y, z, qx, qy, qz, qw (unit), sx, sy, sz (log2 scales), logit. Conics on the image.

    sid, u, v, depth, ca, cb, cc (inverse of the 2 x 2 covariance, whose variances grow by 0.3), radius (three deviations
    along the longer axis), opacity. Splats not between near and far go; a determinant of 1e-10 or less gives the identity.
    """
    m, fx, fy = camera.extrinsics, camera.fx, camera.fy
    seen = [sum((m[4 * b + a] * F.col(c) for b, c in enumerate("xyz")), F.lit(float(m[12 + a]))) for a in range(4)]
    rows = splats.withColumns(dict(zip(("x", "y", "z"), (seen[0] / seen[3], seen[1] / seen[3], seen[2]), strict=True)))
    rows = rows.where((F.col("z") > camera.near) & (F.col("z") < camera.far))
    x, y, z, w = (F.col(q) for q in ("qx", "qy", "qz", "qw"))
    rotation = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]
    scale = [F.pow(F.lit(2.0), F.col(s)) for s in ("sx", "sy", "sz")]
    rows = rows.select("*", *((rotation[a][b] * scale[b]).alias(f"m{a}{b}") for a in range(3) for b in range(3)))
    cov = [[sum((F.col(f"m{a}{k}") * F.col(f"m{b}{k}") for k in (1, 2)), F.col(f"m{a}0") * F.col(f"m{b}0")) for b in range(3)] for a in range(3)]
    rows = rows.select("*", *(cov[a][b].alias(f"s{a}{b}") for a in range(3) for b in range(a, 3)))
    s = lambda a, b: F.col(f"s{min(a, b)}{max(a, b)}")
    inv = 1 / F.col("z")
    j = [[fx * inv, F.lit(0.0), -fx * F.col("x") * inv * inv], [F.lit(0.0), fy * inv, -fy * F.col("y") * inv * inv]]
    form = lambda p, q: sum((j[p][a] * s(a, b) * j[q][b] for a in range(3) for b in range(3) if (a, b) != (0, 0)), j[p][0] * s(0, 0) * j[q][0])
    rows = rows.withColumn("va", form(0, 0) + 0.3).withColumn("vb", form(0, 1)).withColumn("vc", form(1, 1) + 0.3)
    det = F.col("va") * F.col("vc") - F.col("vb") * F.col("vb")
    good = det > 1e-10
    middle = (F.col("va") + F.col("vc")) / 2
    longer = middle + F.sqrt((F.col("va") - F.col("vc")) ** 2 + 4 * F.col("vb") ** 2) / 2
    return rows.select(
        "sid", (fx * F.col("x") * inv + camera.cx).alias("u"), (fy * F.col("y") * inv + camera.cy).alias("v"), F.col("z").alias("depth"),
        F.when(good, F.col("vc") / det).otherwise(1.0).alias("ca"), F.when(good, -F.col("vb") / det).otherwise(0.0).alias("cb"),
        F.when(good, F.col("va") / det).otherwise(1.0).alias("cc"), (3 * F.sqrt(longer)).alias("radius"),
        (1 / (1 + F.exp(-F.col("logit")))).alias("opacity"),
    )


def _blended(projected: DataFrame, colors: DataFrame, width: int, height: int, tile: int, threshold: float) -> DataFrame:
    """px, py, sid, r, g, b, alpha, before (transmittance in front), dx, dy, ca, cb, cc, opacity: what each pixel blends.

    A splat goes to the tiles that the square of its radius touches, then to their pixels; the order within a pixel (depth,
    ties by sid) is a window over that pixel's splats. After a transmittance of 0.001 none counts.
    """
    tiles_x, tiles_y = -(-width // tile), -(-height // tile)

    def span(centre: Column, most: int) -> Column:
        low, high = F.floor((centre - F.col("radius")) / tile).cast("int"), F.floor((centre + F.col("radius")) / tile).cast("int")
        a, b = F.greatest(low, F.lit(0)), F.least(high, F.lit(most - 1))
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    binned = projected.withColumn("tx", F.explode(span(F.col("u"), tiles_x))).withColumn("ty", F.explode(span(F.col("v"), tiles_y)))
    step = F.sequence(F.lit(0), F.lit(tile - 1))
    pixels = binned.withColumn("px", F.explode(F.transform(step, lambda s: F.col("tx") * tile + s))).where(F.col("px") < width)
    pixels = pixels.withColumn("py", F.explode(F.transform(step, lambda s: F.col("ty") * tile + s))).where(F.col("py") < height)
    pixels = pixels.withColumn("dx", F.col("px") - F.col("u")).withColumn("dy", F.col("py") - F.col("v"))
    power = 0.5 * (F.col("ca") * F.col("dx") ** 2 + F.col("cc") * F.col("dy") ** 2) + F.col("cb") * F.col("dx") * F.col("dy")
    alpha = F.when(power > 10, 0.0).otherwise(F.col("opacity") * F.exp(-F.greatest(power, F.lit(0.0))))
    seen = pixels.withColumn("alpha", alpha).where((F.col("alpha") > 0) & (F.col("alpha") >= threshold)).join(colors, "sid")
    order = Window.partitionBy("px", "py").orderBy("depth", "sid").rowsBetween(Window.unboundedPreceding, -1)
    before = F.exp(F.coalesce(F.sum(F.log(_left(F.col("alpha")))).over(order), F.lit(0.0)))
    return seen.withColumn("before", before).where(F.col("before") >= 0.001)


def _left(alpha: Column) -> Column:
    """What an alpha lets through; above 0, so that logarithms and quotients exist."""
    return F.greatest(1 - alpha, F.lit(1e-12))


def rasterize(projected: DataFrame, colors: DataFrame, width: int, height: int, tile: int = 16, threshold: float = 0.005, background=None) -> DataFrame:
    """px, py, r, g, b, through: splats (sid, ...) with colors (sid, r, g, b) blended front to back.

    Pixels without a splat are left out unless a background (r, g, b) is given; then all pixels are there.
    """
    used = _blended(projected, colors, width, height, tile, threshold)
    part = F.col("before") * F.col("alpha")
    out = used.groupBy("px", "py").agg(*(F.sum(part * F.col(c)).alias(c) for c in "rgb"), F.exp(F.sum(F.log(_left(F.col("alpha"))))).alias("through"))
    if background is None:
        return out
    n = F.col("id")
    whole = projected.sparkSession.range(width * height).select((n % width).cast("int").alias("px"), F.floor(n / width).cast("int").alias("py"))
    through = F.coalesce("through", F.lit(1.0))
    shown = (F.coalesce(F.col(c), F.lit(0.0)) + through * float(back) for c, back in zip("rgb", background, strict=True))
    return whole.join(out, ["px", "py"], "left").select("px", "py", *(v.alias(c) for v, c in zip(shown, "rgb", strict=True)), through.alias("through"))


def rasterize_vjp(
    projected: DataFrame, colors: DataFrame, grads: DataFrame, width: int, height: int, tile: int = 16, threshold: float = 0.005, background=(0.0, 0.0, 0.0)
) -> DataFrame:
    """sid, gu, gv, gca, gcb, gcc, gopacity, gr, gg, gb of splats that some pixel blends.

    grads: px, py, gr, gg, gb, ga: what the loss asks of each pixel's colours and of its covered part (1 - through); pixels
    that are not named ask nothing. A window from the back gives what lies behind each splat of a pixel; one sum by splat
    follows, with a map-side part.
    """
    used = _blended(projected, colors, width, height, tile, threshold).join(grads, ["px", "py"])
    asked = lambda r, g, b: r * F.col("gr") + g * F.col("gg") + b * F.col("gb")
    used = used.withColumn("shown", asked(F.col("r"), F.col("g"), F.col("b"))).withColumn("back", asked(*(F.lit(float(c)) for c in background)))
    pixel = Window.partitionBy("px", "py")
    behind = pixel.orderBy(F.desc("depth"), F.desc("sid")).rowsBetween(Window.unboundedPreceding, -1)
    through = F.exp(F.sum(F.log(_left(F.col("alpha")))).over(pixel))
    later = F.coalesce(F.sum(F.col("before") * F.col("alpha") * F.col("shown")).over(behind), F.lit(0.0))
    rest = (later + through * (F.col("back") - F.col("ga"))) / _left(F.col("alpha"))
    used = used.withColumn("da", F.col("before") * F.col("shown") - rest)
    fall, dx, dy = -F.col("alpha") * F.col("da"), F.col("dx"), F.col("dy")
    part = F.col("before") * F.col("alpha")
    each = {
        "gu": -fall * (F.col("ca") * dx + F.col("cb") * dy), "gv": -fall * (F.col("cb") * dx + F.col("cc") * dy), "gca": fall * dx * dx / 2, "gcb": fall * dx * dy,
        "gcc": fall * dy * dy / 2, "gopacity": F.col("da") * F.col("alpha") / F.col("opacity"), "gr": part * F.col("gr"), "gg": part * F.col("gg"), "gb": part * F.col("gb"),
    }
    return used.groupBy("sid").agg(*(F.sum(v).alias(c) for c, v in each.items()))


def relocate(splats: DataFrame) -> DataFrame:
    """sid, opacity, sx, sy, sz of each of `ratio` copies that together show what one splat showed. splats: plain opacity and scales.

    The double sum over copies and powers is one alternating sum over m of C(ratio, m) p^m / sqrt(m), p the new opacity.
    ratio is held between 1 and MOST_COPIES.
    """
    n = F.greatest(F.least(F.col("ratio"), F.lit(MOST_COPIES)), F.lit(1)).cast("int")
    rows = splats.withColumn("_n", n).withColumn("_p", 1 - F.pow(1 - F.col("opacity").cast("double"), 1 / n))
    start = F.struct(F.lit(-1.0).alias("t"), F.lit(0.0).alias("s"))

    def add(held: Column, m: Column) -> Column:
        term = -held["t"] * F.col("_p") * (F.col("_n") - m + 1) / m
        return F.struct(term.alias("t"), (held["s"] + term / F.sqrt(m.cast("double"))).alias("s"))

    total = F.aggregate(F.sequence(F.lit(1), F.col("_n")), start, add)["s"]
    grown = F.when(total != 0, F.col("opacity") / total).otherwise(1.0)
    return rows.withColumn("_k", grown).select("sid", F.col("_p").alias("opacity"), *((F.col("_k") * F.col(c)).alias(c) for c in ("sx", "sy", "sz")))


def add_noise(splats: DataFrame, rate: float) -> DataFrame:
    """sid, x, y, z moved by the splat's covariance times its noise (nx, ny, nz), the less the more opaque it is.

    splats: sid, x, y, z, qx, qy, qz, qw, sx, sy, sz (natural logarithms), logit, nx, ny, nz. The covariance is applied as
    turn back, scale, turn, so that it is never made.
    """
    size = F.sqrt(sum((F.col(q) ** 2 for q in ("qy", "qz", "qw")), F.col("qx") ** 2))
    x, y, z, w = (F.when(size > 1e-8, F.col(q) / size).otherwise(F.col(q)) for q in ("qx", "qy", "qz", "qw"))
    turn = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]
    opacity = 1 / (1 + F.exp(-F.col("logit")))
    gate = rate / (1 + F.exp(100 * (opacity - 0.005)))
    rows = splats.select("*", gate.alias("_g"), *(turn[a][b].alias(f"_m{a}{b}") for a in range(3) for b in range(3)))
    m = lambda a, b: F.col(f"_m{a}{b}")
    inner = [F.exp(2 * F.col(c)) * (m(0, b) * F.col("nx") + m(1, b) * F.col("ny") + m(2, b) * F.col("nz")) for b, c in enumerate(("sx", "sy", "sz"))]
    rows = rows.select("*", *(v.alias(f"_i{b}") for b, v in enumerate(inner)))
    return rows.select("sid", *((F.col(c) + F.col("_g") * (m(a, 0) * F.col("_i0") + m(a, 1) * F.col("_i1") + m(a, 2) * F.col("_i2"))).alias(c) for a, c in enumerate("xyz")))
