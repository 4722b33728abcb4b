"""Image processing and metrics on pixel tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cplx


def minmax(df: DataFrame, image: list[str], value: str = "x") -> DataFrame:
    """Adds ``scaled`` from 0 to 1 within each image; NaN where an image is constant."""
    w = Window.partitionBy(*image)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("scaled", F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(float("nan"))))


def standardize(df: DataFrame, image: list[str], value: str = "x") -> DataFrame:
    """Adds ``scaled``: less the mean, over the population deviation."""
    w = Window.partitionBy(*image)
    return df.withColumn("scaled", F.coalesce(F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)), F.lit(float("nan"))))


def magnitude_mask(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Adds ``masked``: magnitude above the threshold; NaN is not."""
    size = F.hypot("re", "im")
    return df.withColumn("masked", (size > threshold) & ~F.isnan(size))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def metrics(pairs: DataFrame) -> DataFrame:
    """One row of error figures of pixels (re, im, ref_re, ref_im).

    mse of the real parts; alignment scale <x, ref> / <x, x> (1 for x = 0); relative errors raw,
    aligned, and of magnitudes.  A zero reference or a value that is not finite raises.
    """
    c = F.col
    bad = F.max(F.when(_finite(c("re")) & _finite(c("im")) & _finite(c("ref_re")) & _finite(c("ref_im")), 0).otherwise(1)).alias("bad")
    mag, ref_mag = F.hypot("re", "im"), F.hypot("ref_re", "ref_im")
    s = pairs.agg(
        bad, F.count(F.lit(1)).alias("n"), F.sum((c("re") - c("ref_re")) ** 2).alias("d_re"),
        F.sum(c("re") * c("ref_re") + c("im") * c("ref_im")).alias("xr"), F.sum(c("re") * c("ref_im") - c("im") * c("ref_re")).alias("xi"),
        F.sum(c("re") ** 2 + c("im") ** 2).alias("xx"), F.sum(c("ref_re") ** 2 + c("ref_im") ** 2).alias("rr"),
        F.sum((c("re") - c("ref_re")) ** 2 + (c("im") - c("ref_im")) ** 2).alias("dd"), F.sum((mag - ref_mag) ** 2).alias("mm"),
    )
    raise_if = F.when((c("bad") == 1) | (c("rr") == 0), F.raise_error(F.lit("values must be finite and the reference not zero"))).otherwise(F.lit(0.0))
    a_re, a_im = F.when(c("xx") == 0, 1.0).otherwise(F.try_divide("xr", "xx")), F.when(c("xx") == 0, 0.0).otherwise(F.try_divide("xi", "xx"))
    left = F.when(c("xx") == 0, c("dd")).otherwise(F.greatest(c("rr") - F.try_divide(c("xr") ** 2 + c("xi") ** 2, c("xx")), F.lit(0.0)))
    return s.select(
        (F.try_divide("d_re", "n") + raise_if).alias("mse"), a_re.alias("scale_re"), a_im.alias("scale_im"),
        F.sqrt(F.try_divide("dd", "rr")).alias("nrmse"), F.sqrt(F.try_divide(left, c("rr"))).alias("aligned_nrmse"),
        F.sqrt(F.try_divide("mm", "rr")).alias("magnitude_nrmse"),
    )


def scale_to(pairs: DataFrame) -> DataFrame:
    """The aligned pixels: (re, im) times the scale <x, ref> / <x, x>, ref unchanged."""
    s = pairs.agg(
        F.sum(F.col("re") * F.col("ref_re") + F.col("im") * F.col("ref_im")).alias("xr"), F.sum(F.col("re") * F.col("ref_im") - F.col("im") * F.col("ref_re")).alias("xi"),
        F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("xx"),
    )
    s = s.select(F.when(F.col("xx") == 0, 1.0).otherwise(F.try_divide("xr", "xx")).alias("_sr"), F.when(F.col("xx") == 0, 0.0).otherwise(F.try_divide("xi", "xx")).alias("_si"))
    both = pairs.join(F.broadcast(s))  # one row
    re, im = cplx.mul((F.col("re"), F.col("im")), (F.col("_sr"), F.col("_si")))
    return both.withColumns({"_re": re, "_im": im}).drop("re", "im", "_sr", "_si").withColumnsRenamed({"_re": "re", "_im": "im"})


def aligned_magnitude_nrmse(pairs: DataFrame) -> DataFrame:
    """The relative error of magnitudes after alignment."""
    return metrics(scale_to(pairs)).select(F.col("magnitude_nrmse").alias("aligned_magnitude_nrmse"))


def against(reference: DataFrame, image: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, re, im) of a reference and an image as pairs, the reference named first."""
    return image.join(reference.select(*keys, F.col("re").alias("ref_re"), F.col("im").alias("ref_im")), keys)


def reference_metrics(reference: DataFrame, image: DataFrame, keys: list[str]) -> DataFrame:
    """(scale_re, scale_im, mse, rmse, nrmse) of an image against a reference, real parts for the first errors."""
    return metrics(against(reference, image, keys)).select("scale_re", "scale_im", "mse", F.sqrt("mse").alias("rmse"), "nrmse")


def cast_precision(df: DataFrame, kind: str, names: list[str] | None = None) -> DataFrame:
    """Floating columns (all, or ``names``) and arrays of them as ``float`` or ``double``."""
    if kind not in ("float", "double"):
        raise ValueError(f"unknown precision: {kind}")
    out = {}
    for f in df.schema.fields:
        plain = f.dataType.simpleString()
        if (names is None or f.name in names) and plain in ("float", "double", "array<float>", "array<double>"):
            out[f.name] = F.col(f.name).cast(f"array<{kind}>" if plain.startswith("array") else kind)
    return df.withColumns(out)


def center_start(size: int, want: int) -> int:
    """First index (from 0) of ``want`` places in the middle of ``size``."""
    return size // 2 - want // 2


def center_window(df: DataFrame, sizes: tuple[int, int], want: tuple[int, int], image: list[str], value: str = "x", compat: bool = False) -> DataFrame:
    """Pixels (image.., i, j, value) cropped or zero-padded about the centre to ``want``.

    ``compat`` gives zeros throughout where a size stays as it is, as the established routine does.
    """
    shift = [center_start(s, w) if w <= s else -center_start(w, s) for s, w in zip(sizes, want, strict=True)]
    moved = df.withColumns({"i": F.col("i") - shift[0], "j": F.col("j") - shift[1]})
    moved = moved.where(F.col("i").between(0, want[0] - 1) & F.col("j").between(0, want[1] - 1)).select(*image, "i", "j", value)
    if compat and (sizes[0] == want[0] or sizes[1] == want[1]):
        moved = moved.withColumn(value, F.lit(0.0))
    frame = df.select(*image).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(want[0] - 1))))
    frame = frame.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(want[1] - 1))))
    keys = [*image, "i", "j"]
    moved = moved.withColumns({"i": F.col("i").cast("int"), "j": F.col("j").cast("int")})
    return frame.join(moved, keys, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def reorient(df: DataFrame, size: tuple[int, int], shift: tuple[int, int] = (0, 0), reverse_i: bool = True, swap: bool = True) -> DataFrame:
    """Pixels rolled by ``shift``, reversed along i, and with both axes swapped: index arithmetic only.

    Maps, fields and masks take the same call, so they stay aligned.
    """
    i, j = (F.pmod(F.col(c) + s, F.lit(n)).cast("int") for c, s, n in zip("ij", shift, size, strict=True))
    i = F.lit(size[0] - 1) - i if reverse_i else i
    moved = df.withColumns({"_i": j if swap else i, "_j": i if swap else j})
    return moved.withColumns({"i": F.col("_i"), "j": F.col("_j")}).drop("_i", "_j")


def mosaic(df: DataFrame, size: tuple[int, int], rows: int, cols: int, index: str = "n", value: str = "x") -> DataFrame:
    """(row, col, value): images 0..rows*cols-1 tiled row by row; missing ones are zero."""
    h, w = size
    placed = df.where(F.col(index) < rows * cols).select(
        (F.floor(F.col(index) / cols) * h + F.col("i")).cast("long").alias("row"), (F.pmod(F.col(index), F.lit(cols)) * w + F.col("j")).cast("long").alias("col"), value
    )
    spark = df.sparkSession
    frame = spark.range(rows * h * cols * w).select(F.floor(F.col("id") / (cols * w)).alias("row"), (F.col("id") % (cols * w)).alias("col"))
    return frame.join(placed, ["row", "col"], "left").select("row", "col", F.coalesce(value, F.lit(0.0)).alias(value))


def resize(df: DataFrame, size: tuple[int, int], want: tuple[int, int], image: list[str], value: str = "x") -> DataFrame:
    """Bilinear resize of images (image.., i, j, value): pixel centres of both grids span the same area."""
    spark, keys = df.sparkSession, image
    grid = spark.range(want[0] * want[1]).select((F.col("id") % want[0]).cast("int").alias("oi"), F.floor(F.col("id") / want[0]).cast("int").alias("oj"))
    for out, s, w in (("i", size[0], want[0]), ("j", size[1], want[1])):
        u = F.least(F.greatest((F.col(f"o{out}") + 0.5) * (s / w) - 0.5, F.lit(0.0)), F.lit(float(s - 1)))
        low = F.least(F.floor(u), F.lit(max(s - 2, 0)))
        near = F.array(*[F.struct((low + k).cast("int").alias("at"), ((u - low) if k else (1 - (u - low))).alias("w")) for k in ((0, 1) if s > 1 else (0,))])
        grid = grid.withColumn(f"_{out}", F.explode(near))
    # The stencil has four rows for each target pixel: the frame of one image, not of all.
    grid = grid.select("oi", "oj", F.col("_i.at").alias("i"), F.col("_j.at").alias("j"), (F.col("_i.w") * F.col("_j.w")).alias("_w"))
    joined = df.withColumns({"i": F.col("i").cast("int"), "j": F.col("j").cast("int")}).join(F.broadcast(grid), ["i", "j"])
    return joined.groupBy(*keys, F.col("oi").alias("i"), F.col("oj").alias("j")).agg(F.sum(F.col("_w") * F.col(value)).alias(value))


def resize_complex(df: DataFrame, size, want, image: list[str]) -> DataFrame:
    """Complex images resized by magnitude and wrapped phase apart."""
    polar = df.withColumns({"_m": F.hypot("re", "im"), "_p": F.atan2("im", "re")})
    m, p = resize(polar, size, want, image, "_m"), resize(polar, size, want, image, "_p")
    both = m.join(p, [*image, "i", "j"])
    return both.select(*image, "i", "j", (F.col("_m") * F.cos("_p")).alias("re"), (F.col("_m") * F.sin("_p")).alias("im"))


def dft2(df: DataFrame, size: tuple[int, int], image: list[str], inverse: bool = False) -> DataFrame:
    """Centred transform of small images (image.., i, j, re, im) as a join on separable factors.

    The inverse is scaled by 1, the forward by 1 / n: the established pair of conventions.
    """
    spark, out = df.sparkSession, df
    sign = 1 if inverse else -1
    for axis, n in (("i", size[0]), ("j", size[1])):
        f = np.exp(sign * 2j * np.pi * np.outer(np.arange(n) - n // 2, np.arange(n) - n // 2) / n) / (1 if inverse else n)
        rows = [(a, b, float(f[a, b].real), float(f[a, b].imag)) for a in range(n) for b in range(n)]
        # n * n rows: the sizes are those of one image.
        table = F.broadcast(spark.createDataFrame(rows, f"{axis} int, _to int, _fr double, _fi double"))
        other = "j" if axis == "i" else "i"
        joined = out.withColumn(axis, F.col(axis).cast("int")).join(table, axis)
        out = joined.groupBy(*image, other, "_to").agg(
            F.sum(F.col("re") * F.col("_fr") - F.col("im") * F.col("_fi")).alias("re"), F.sum(F.col("re") * F.col("_fi") + F.col("im") * F.col("_fr")).alias("im")
        ).withColumnRenamed("_to", axis)
    return out.select(*image, "i", "j", "re", "im")


def centered_fft(x: np.ndarray, axes, inverse: bool = False) -> np.ndarray:
    """The same transforms of an array: inverse times n, forward over n."""
    n = np.prod([x.shape[a] for a in axes])
    f = np.fft.ifftn if inverse else np.fft.fftn
    return np.fft.fftshift(f(np.fft.ifftshift(x, axes=axes), axes=axes), axes=axes) * (n if inverse else 1 / n)


def ssim(x: np.ndarray, ref: np.ndarray, sigma: float = 1.5, width: int = 11) -> float:
    """Mean structural similarity (Wang et al. 2004) of magnitudes over the reference's peak; borders mirrored."""
    x, ref = np.abs(x), np.abs(ref)
    peak = ref.max()
    if x.shape != ref.shape or not peak > 0 or not (np.isfinite(x).all() and np.isfinite(ref).all()):
        raise ValueError("images must agree in shape, be finite, and the reference not zero")
    x, ref = x / peak, ref / peak
    t = np.arange(width) - width // 2
    g = np.exp(-(t**2) / (2 * sigma**2))
    g /= g.sum()

    def blur(a):
        h = width // 2
        for axis in (0, 1):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (h, h)
            wide = np.pad(a, pad, "symmetric")
            a = sum(w * np.take(wide, range(i, i + a.shape[axis]), axis) for i, w in enumerate(g))
        return a

    mx, mr = blur(x), blur(ref)
    vx, vr, c = blur(x * x) - mx * mx, blur(ref * ref) - mr * mr, blur(x * ref) - mx * mr
    k1, k2 = 0.01**2, 0.03**2
    return float((((2 * mx * mr + k1) * (2 * c + k2)) / ((mx**2 + mr**2 + k1) * (vx + vr + k2))).mean())


def ssim_by_image(df: DataFrame, size: tuple[int, int], image: str = "n") -> DataFrame:
    """(image, ssim) of pixel rows (image, i, j, x, ref); one group is one image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros(size), np.zeros(size)
        a[pdf["i"], pdf["j"]], b[pdf["i"], pdf["j"]] = pdf["x"], pdf["ref"]
        return pd.DataFrame({image: [pdf[image].iloc[0]], "ssim": [ssim(a, b)]})

    return df.groupBy(image).applyInPandas(run, f"{image} {df.schema[image].dataType.simpleString()}, ssim double")


def display_window(df: DataFrame, image: list[str], low: float = 0.01, high: float = 0.99, value: str = "x") -> DataFrame:
    """Display limits of each image: exact percentiles."""
    return df.groupBy(*image).agg(F.percentile(value, F.lit(low)).alias("vmin"), F.percentile(value, F.lit(high)).alias("vmax"))
