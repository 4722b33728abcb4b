"""Multichannel time series: integration, differences, filters and interpolation.

Series are tables with a key (shot), an index j from 0 and a value; each operator is one window
over (key, j), so a shuffle by key at most and none if the table is already dealt by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: list[str], j: str):
    return Window.partitionBy(*keys).orderBy(j)


def cumulative_trapezoid(df: DataFrame, keys: list[str], dt: float, j: str = "j", value: str = "value") -> DataFrame:
    """Adds ``integral``: the trapezoid sum up to each sample, 0 at the first."""
    w = _by(keys, j)
    step = F.coalesce((F.lag(value).over(w) + F.col(value)) * (dt / 2), F.lit(0.0))
    return df.withColumn("_step", step).withColumn("integral", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def forward_difference(df: DataFrame, keys: list[str], dt: float, j: str = "j", value: str = "value") -> DataFrame:
    """Adds ``slope`` = (next - this) / dt and drops each series' last sample."""
    return df.withColumn("slope", (F.lead(value).over(_by(keys, j)) - F.col(value)) / dt).where("slope is not null")


def fir_derivative(df: DataFrame, keys: list[str], dt: float, j: str = "j", value: str = "value") -> DataFrame:
    """Adds ``slope``: a five-tap derivative; samples beyond the ends count as 0."""
    w = _by(keys, j)
    at = lambda k: F.coalesce((F.lead(value, k) if k > 0 else F.lag(value, -k)).over(w), F.lit(0.0))
    return df.withColumn("slope", (at(2) / 8 + at(1) / 4 - at(-1) / 4 - at(-2) / 8) / dt)


def fir_derivatives(df: DataFrame, keys: list[str], dt: float, n: int, j: str = "j", value: str = "value") -> DataFrame:
    """As ``fir_derivative``, of the first ``n`` elements of an array, each by itself: ``slope`` is an array."""
    w = _by(keys, j)
    taps = {"_m2": F.lag(value, 2), "_m1": F.lag(value), "_p1": F.lead(value), "_p2": F.lead(value, 2)}
    at = lambda tap, i: F.coalesce(F.get(tap, F.lit(i)), F.lit(0.0))
    slope = F.array(*[(at("_p2", i) / 8 + at("_p1", i) / 4 - at("_m1", i) / 4 - at("_m2", i) / 8) / dt for i in range(n)])
    return df.withColumns({t: c.over(w) for t, c in taps.items()}).withColumn("slope", slope).drop(*taps)


def with_next(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Adds ``after``: the next sample's value."""
    return series.withColumn("after", F.lead(value).over(_by(keys, "j")))


def interpolate_arrays(nodes: DataFrame, times: DataFrame, keys: list[str], dt: float, n: int, value: str = "value") -> DataFrame:
    """As ``interpolate_linear``, of the first ``n`` elements of arrays by one join; nodes are (keys, j, value, after) as ``with_next`` makes them."""
    rows = nodes.select(*keys, F.col("j").cast("long").alias("j"), F.col(value).alias("_a"), F.col("after").alias("_b"))
    got, f = _bracketed(rows, times, keys, dt, value), F.col("_f")
    a, b = (F.slice(x, 1, n) for x in ("_a", "_b"))
    between = F.zip_with(a, b, lambda x, y: F.coalesce(F.when(y.isNotNull(), x + f * (y - x)).when(f == 0, x), F.lit(0.0)))
    last = F.when(f == 0, F.transform(a, lambda x: F.coalesce(x, F.lit(0.0))))
    return got.withColumn(value, F.coalesce(between, last, F.array(*[F.lit(0.0)] * n))).drop("_a", "_b", "_f", "_u", "j")


def _bracketed(series: DataFrame, times: DataFrame, keys: list[str], dt: float, value: str) -> DataFrame:
    """Joins each time (column t) with the samples j and j + 1 around it: an equi-join, as samples are equispaced."""
    at = times.withColumn("_u", F.col("t") / dt).withColumn("j", F.floor("_u").cast("long")).withColumn("_f", F.col("_u") - F.col("j"))
    return at.join(series, [*keys, "j"], "left")


def interpolate_linear(series: DataFrame, times: DataFrame, keys: list[str], dt: float, value: str = "value") -> DataFrame:
    """``times`` (keys, t, ...) with ``value``: linear between samples at j * dt, 0 outside."""
    w = _by(keys, "j")
    nodes = series.select(*keys, F.col("j").cast("long").alias("j"), F.col(value).alias("_a"), F.lead(value).over(w).alias("_b"))
    got = _bracketed(nodes, times, keys, dt, value)
    out = F.when(F.col("_b").isNotNull(), F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).when(F.col("_f") == 0, F.col("_a"))
    return got.withColumn(value, F.coalesce(out, F.lit(0.0))).drop("_a", "_b", "_f", "_u", "j")


def akima_slopes(nodes: DataFrame, keys: list[str], dt: float, value: str) -> DataFrame:
    """Adds ``_m``: the modified Akima slope at every node.

    A slope is the mean of the neighbouring secants, each weighted by how much the other side
    bends; beyond the ends secants are extended linearly.
    """
    w = _by(keys, "j")
    nodes = nodes.withColumn("_d", (F.lead(value).over(w) - F.col(value)) / dt)
    nodes = nodes.withColumns({f"_s{k}": (F.lead("_d", k) if k >= 0 else F.lag("_d", -k)).over(w) for k in (-2, -1, 0, 1)})
    s = {k: F.col(f"_s{k}") for k in (-2, -1, 0, 1)}
    # Extension by linear secants at both ends.
    s[0] = F.coalesce(s[0], 2 * s[-1] - s[-2], s[-1])
    s[-1] = F.coalesce(s[-1], 2 * s[0] - s[1], s[0])
    s[1] = F.coalesce(s[1], 2 * s[0] - s[-1])
    s[-2] = F.coalesce(s[-2], 2 * s[-1] - s[0])
    left = F.abs(s[1] - s[0]) + F.abs(s[1] + s[0]) / 2
    right = F.abs(s[-1] - s[-2]) + F.abs(s[-1] + s[-2]) / 2
    total = left + right
    slope = F.when(total == 0, F.lit(0.0)).otherwise((left * s[-1] + right * s[0]) / F.when(total == 0, 1.0).otherwise(total))
    return nodes.withColumn("_m", F.coalesce(slope, F.lit(0.0))).drop("_d", *[f"_s{k}" for k in (-2, -1, 0, 1)])


def interpolate_akima(series: DataFrame, times: DataFrame, keys: list[str], dt: float, value: str = "value") -> DataFrame:
    """Like ``interpolate_linear`` with cubic Hermite pieces over modified Akima slopes."""
    w = _by(keys, "j")
    nodes = akima_slopes(series.select(*keys, F.col("j").cast("long").alias("j"), F.col(value)), keys, dt, value)
    nodes = nodes.select(
        *keys, "j", F.col(value).alias("_a"), F.lead(value).over(w).alias("_b"), F.col("_m").alias("_ma"), F.lead("_m").over(w).alias("_mb")
    )
    got = _bracketed(nodes, times, keys, dt, value)
    f = F.col("_f")
    cubic = (
        (2 * f * f * f - 3 * f * f + 1) * F.col("_a") + (f * f * f - 2 * f * f + f) * dt * F.col("_ma")
        + (3 * f * f - 2 * f * f * f) * F.col("_b") + (f * f * f - f * f) * dt * F.col("_mb")
    )
    out = F.when(F.col("_b").isNotNull(), cubic).when(f == 0, F.col("_a"))
    return got.withColumn(value, F.coalesce(out, F.lit(0.0))).drop("_a", "_b", "_ma", "_mb", "_f", "_u", "j")


def resampled(series: DataFrame, keys: list[str], dt: float, delay: Column | float, value: str = "value", method: str = "akima") -> DataFrame:
    """``series`` (keys, j, value) at its own times less ``delay``."""
    at = series.select(*keys, F.col("j").alias("i"), (F.col("j") * dt + (F.lit(delay) if isinstance(delay, float | int) else delay)).alias("t"))
    run = {"akima": interpolate_akima, "linear": interpolate_linear}[method]
    return run(series, at, keys, dt, value).select(*keys, F.col("i").alias("j"), value)


def with_time(series: DataFrame, dt: float) -> DataFrame:
    """Adds ``ms``: the time of each sample, from 1, in milliseconds, as axes show it."""
    return series.withColumn("ms", (F.col("j") + 1) * dt * 1e3)


def gradient_units(df: DataFrame, names: list[str], gamma: float = 42.58e6) -> DataFrame:
    """Gradients from Hz/m to mT/m."""
    return df.withColumns({n: F.col(n) / gamma * 1e3 for n in names})


def display_limits(df: DataFrame, names: list[str], margin: float = 0.1) -> DataFrame:
    """(low, high): limits of all ``names`` together, wider by a share of the largest magnitude on each side."""
    low, high = (f(*[g(n) for n in names]) if len(names) > 1 else g(names[0]) for f, g in ((F.least, F.min), (F.greatest, F.max)))
    extra = F.greatest(F.abs(low), F.abs(high)) * margin
    return df.agg((low - extra).alias("low"), (high + extra).alias("high"))


def smooth_length(n: int) -> int:
    """The least length of at least n whose prime factors are 2, 3 and 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def apply_response(waves: DataFrame, response, key: str = "wave", bandwidth: float = 1.0, drop_bin: bool = True) -> DataFrame:
    """Gradient waveforms (wave, i, j, value) through a response array [frequency, 3, outputs].

    Every waveform is one group: zero-padded to a smooth length, transformed, mixed from 3 inputs to
    the outputs at each frequency, and transformed back (wave, o, j, value).  The response grows to
    longer waveforms by zeros in time; ``drop_bin`` leaves out the middle bin in doing so, as the
    established convention does.  ``bandwidth`` below 1 zeroes the outer share of bins.
    """
    import numpy as np
    import pandas as pd

    response = np.asarray(response)
    n_freq, _, n_out = response.shape

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["j"].max()) + 1
        g = np.zeros((n, 3))
        g[pdf["j"], pdf["i"]] = pdf["value"]
        size = smooth_length(max(n, n_freq))
        h = expand_response(response, size, drop_bin)
        if bandwidth < 1:
            edge = int(np.rint(size * (1 - bandwidth) / 2))
            h = h.copy()
            h[:edge] = 0
            h[size - edge :] = 0
        spectrum = np.fft.fftshift(np.fft.fft(g, size, axis=0), axes=0)
        out = np.fft.ifft(np.fft.ifftshift(np.einsum("fi,fio->fo", spectrum, h), axes=0), axis=0).real[:n]
        j, o = np.meshgrid(np.arange(n), np.arange(n_out), indexing="ij")
        return pd.DataFrame({key: pdf[key].iloc[0], "o": o.ravel().astype(np.int32), "j": j.ravel(), "value": out.ravel()})

    kind = waves.schema[key].dataType.simpleString()
    return waves.groupBy(key).applyInPandas(run, f"{key} {kind}, o int, j long, value double")


def expand_response(response, size: int, drop_bin: bool = True):
    """A response on more frequencies: its impulse response padded with zeros in the middle."""
    import numpy as np

    n = len(response)
    if size == n:
        return response
    impulse = np.fft.ifft(np.fft.ifftshift(response, axes=0), axis=0)
    out = np.zeros((size, *response.shape[1:]), complex)
    half = n // 2
    out[:half] = impulse[:half]
    tail = half + 1 if drop_bin else half
    if n > tail:
        out[size - (n - tail) :] = impulse[tail:]
    return np.fft.fftshift(np.fft.fft(out, axis=0), axes=0)


class ResponseModel:
    """A response [frequency, 3, outputs] with its frequencies, applied to waveforms and split into its parts."""

    def __init__(self, response, freqs=None):
        import numpy as np

        self.response = np.asarray(response)
        if self.response.ndim != 3 or self.response.shape[1] != 3:
            raise ValueError("a response has frequencies, three inputs and outputs")
        self.freqs = np.arange(len(self.response)) if freqs is None else np.asarray(freqs)
        if len(self.freqs) != len(self.response):
            raise ValueError("there must be one frequency for each bin")

    def apply(self, waves: DataFrame, key: str = "wave", bandwidth: float = 1.0) -> DataFrame:
        """(key, o, j, value, part)."""
        return split_outputs(apply_response(waves, self.response, key, bandwidth), self.response.shape[2])


def split_outputs(predicted: DataFrame, n_out: int) -> DataFrame:
    """Adds ``part`` to channel rows: k0 (first), linear (next three), higher; under four all are linear."""
    o = F.col("o")
    part: Column = F.when(o == 0, "k0").when(o <= 3, "linear").otherwise("higher") if n_out >= 4 else F.lit("linear")
    return predicted.withColumn("part", part)
