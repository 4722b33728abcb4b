"""Channel algebra: covariance, whitening, compression and combination of receive channels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared


def covariance(obs: DataFrame, center: bool = True, complex_: bool = True) -> DataFrame:
    """(i, j, re, im) of E[conj(n_i) n_j] over observations (obs, c, re[, im]).

    The channels of an observation are packed into one row first, so the pairs are made inside the
    row and summed on the map side: one shuffle of the observations, one of channel pairs.
    ``center`` removes means and divides by n - 1, else by n.
    """
    im = F.col("im") if complex_ else F.lit(0.0)
    rows = obs.groupBy("obs").agg(F.collect_list(F.struct("c", F.col("re").cast("double").alias("re"), im.cast("double").alias("im"))).alias("v"))
    if center:
        means = obs.groupBy("c").agg(F.avg("re").alias("mr"), F.avg(im).alias("mi"))
    pairs = rows.select(F.explode("v").alias("a"), "v").select("a", F.explode("v").alias("b"))
    a, b = F.col("a"), F.col("b")
    sums = pairs.groupBy(a["c"].alias("i"), b["c"].alias("j")).agg(
        F.sum(a["re"] * b["re"] + a["im"] * b["im"]).alias("sr"), F.sum(a["re"] * b["im"] - a["im"] * b["re"]).alias("si"), F.count(F.lit(1)).alias("n")
    )
    if not center:
        return sums.select("i", "j", (F.col("sr") / F.col("n")).alias("re"), (F.col("si") / F.col("n")).alias("im"))
    # The means table has one row for each channel.
    for side, r, m in (("i", "ar", "ai"), ("j", "br", "bi")):
        sums = sums.join(F.broadcast(means.select(F.col("c").alias(side), F.col("mr").alias(r), F.col("mi").alias(m))), side)
    n = F.col("n")
    re = (F.col("sr") - n * (F.col("ar") * F.col("br") + F.col("ai") * F.col("bi"))) / (n - 1)
    im_ = (F.col("si") - n * (F.col("ar") * F.col("bi") - F.col("ai") * F.col("br"))) / (n - 1)
    return sums.select("i", "j", re.alias("re"), im_.alias("im"))


def collected(cov: DataFrame, n: int) -> np.ndarray:
    """A channel by channel table as a matrix on the driver (n is the number of channels)."""
    out = np.zeros((n, n), complex)
    for r in cov.collect():
        out[r["i"], r["j"]] = complex(r["re"], r["im"])
    return out


def bandwidth_scale(t_acq: float, t_noise: float, ratio: float = 1.0) -> float:
    """(t_acq / t_noise) * ratio, all positive and finite."""
    s = t_acq / t_noise * ratio if t_noise > 0 else float("nan")
    if not np.isfinite(s) or s <= 0 or t_acq <= 0:
        raise ValueError("durations and ratio must be positive and finite")
    return s


def whitening(cov: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """W = sqrt(scale) * inv(U) of the Cholesky factor cov = U^H U."""
    if cov.ndim != 2 or cov.shape[0] != cov.shape[1] or not np.isfinite(cov).all():
        raise ValueError("the covariance must be square and finite")
    if not np.allclose(cov, cov.conj().T, rtol=1e-8, atol=1e-12 * max(np.abs(cov).max(), 1e-300)):
        raise ValueError("the covariance must be Hermitian")
    try:
        upper = np.linalg.cholesky((cov + cov.conj().T) / 2).conj().T
    except np.linalg.LinAlgError as e:
        raise ValueError("the covariance must be positive definite") from e
    return np.sqrt(scale) * np.linalg.inv(upper)


@dataclass(frozen=True)
class Compression:
    """matrix maps channels to virtual channels; sigma are all singular values of the fit."""

    matrix: np.ndarray
    sigma: np.ndarray
    retained: float

    def table(self, spark) -> DataFrame:
        rows = [(i, j, float(z.real), float(z.imag)) for (i, j), z in np.ndenumerate(self.matrix.astype(complex))]
        return spark.createDataFrame(rows, "c int, out int, re double, im double")


def fit_compression(gram: np.ndarray, count: int | None = None, energy: float | None = None, white: np.ndarray | None = None) -> Compression:
    """Compression from the Gram matrix X^H X of calibration rows, by number of channels or by energy kept."""
    if (count is None) == (energy is None):
        raise ValueError("give either a count or an energy")
    w = np.eye(len(gram)) if white is None else white
    values, vectors = np.linalg.eigh(w.conj().T @ gram @ w)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    if values.sum() <= 0:
        raise ValueError("the calibration is zero")
    share = np.cumsum(values) / values.sum()
    rank = count if count is not None else int(np.searchsorted(share, energy - 1e-15) + 1)
    if not 1 <= rank <= len(gram):
        raise ValueError(f"cannot keep {rank} of {len(gram)} channels")
    return Compression(w @ vectors[:, :rank], np.sqrt(values), float(share[rank - 1]))


def apply_compression(df: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, c, re, im) onto virtual channels by matrix (c, out, re, im), which has channels^2 rows at most."""
    m = F.broadcast(matrix.select("c", "out", F.col("re").alias("_mr"), F.col("im").alias("_mi")))
    # Rows are dealt by key first: sums are made where all rows of a key are, so no task holds sums of more than its share of keys.
    joined = df.repartition(*keys).join(m, "c")
    re = F.sum(F.col("re") * F.col("_mr") - F.col("im") * F.col("_mi")).alias("re")
    im = F.sum(F.col("re") * F.col("_mi") + F.col("im") * F.col("_mr")).alias("im")
    return joined.groupBy(*keys, F.col("out").alias("c")).agg(re, im)


def inferred_scale(matrix: np.ndarray, cov: np.ndarray | None = None) -> float:
    """The noise level of virtual channels: the mean of the diagonal of C^H Psi C, 1 without a covariance."""
    return 1.0 if cov is None else float(np.trace(matrix.conj().T @ cov @ matrix).real / matrix.shape[1])


def compress_coils(data: DataFrame, csm: DataFrame, channels: int, keys: list[str], count: int | None = None, energy: float | None = None,
                   noise: np.ndarray | None = None, scale: float = 1.0) -> tuple[DataFrame, DataFrame, Compression]:
    """Data (keys, c, re, im) and maps (v, c, re, im) on virtual channels that are fitted to the data, and the fit."""
    key = F.xxhash64(*keys) if len(keys) > 1 else F.col(keys[0])
    moments = covariance(data.select(key.alias("obs"), "c", "re", "im"), center=False)
    white = None if noise is None else whitening(noise, scale)
    fit = fit_compression(collected(moments, channels), count, energy, white)
    table = fit.table(data.sparkSession)
    return apply_compression(data, table, keys), apply_compression(csm, table, ["v"]), fit


def root_sum_of_squares(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sqrt(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("rss"))


def channel_energy(csm: DataFrame) -> DataFrame:
    return csm.groupBy("v").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("energy"))


def balanced_ranges(df: DataFrame, parts: int, order: str) -> DataFrame:
    """Adds ``part``: balanced contiguous ranges, the first ones longer by one where they do not divide.

    Ranks come from counts of ranges of ``order``, so no task sorts the whole table.
    """
    # Written once: rows of a lost executor come back in the same ranges.
    ranged = shared.cut(df.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").count()
    base = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1 + F.col("_before")
    n = ranged.count()
    size, more = n // parts, n % parts
    placed = ranged.join(F.broadcast(base.drop("count")), "_range").withColumn("_at", rank)
    edge = more * (size + 1)
    part = F.when(F.col("_at") < edge, F.floor(F.col("_at") / (size + 1))).otherwise(more + F.floor((F.col("_at") - edge) / max(size, 1)))
    return placed.withColumn("part", part.cast("long")).drop("_range", "_before", "_at")
