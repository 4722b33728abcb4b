"""Weighted iterative reconstruction, sampling density and clock offsets: loops of distributed products."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared
from . import encode, series
from .encode import ExplicitOp
from .transform import SlabTransform


def _squares(re: str, im: str) -> Column:
    return F.coalesce(F.sum(F.col(re) * F.col(re) + F.col(im) * F.col(im)), F.lit(0.0))


def reconstruct(op: ExplicitOp | encode.NearOp, data: DataFrame | None, weights: DataFrame | None = None, iterations: int = 20, l2: float = 0.0, tol: float = 1e-12) -> DataFrame:
    """The image minimising |W (A x - y)|^2 + l2 |x|^2 by conjugate gradients on the normal equations.

    ``weights`` (p, w_re, w_im) are applied to data and operator alike, so |w|^2 enters the normal
    product.  ``op`` is any operator with voxels, normal and adjoint; one whose samples have their own signal takes no ``data``.  Image, residual, direction and product are columns of
    one table by voxel, which is written once a step, so lineage ends there; the driver gets four sums a step.
    """
    squared, y = None, data
    if weights is not None:
        squared = weights.select("p", (F.col("w_re") ** 2 + F.col("w_im") ** 2).alias("w"))
        y = data.join(squared, "p").select("p", "c", (F.col("re") * F.col("w")).alias("re"), (F.col("im") * F.col("w")).alias("im"))
    r = op.adjoint(y, op.voxels).withColumnsRenamed({"re": "r_re", "im": "r_im"})
    state, sums = shared.cut_with(r, rr=_squares("r_re", "r_im"))
    zero = F.lit(0.0)
    state, rr = state.withColumns({"x_re": zero, "x_im": zero, "p_re": F.col("r_re"), "p_im": F.col("r_im")}), sums["rr"]
    stop = tol**2 * rr
    for _ in range(iterations):
        if rr <= stop or rr == 0:
            break
        product = op.normal(state.select("v", F.col("p_re").alias("re"), F.col("p_im").alias("im")), squared)
        product = product.select("v", F.col("re").alias("h_re"), F.col("im").alias("h_im"))
        both = state.join(product, "v", "left")
        both = both.withColumns({f"h_{z}": F.coalesce(f"h_{z}", zero) + l2 * F.col(f"p_{z}") for z in ("re", "im")})
        both, sums = shared.cut_with(both, ph=F.sum(F.col("p_re") * F.col("h_re") + F.col("p_im") * F.col("h_im")))
        alpha = rr / sums["ph"]
        move = lambda a, b, by: {f"{a}_{z}": F.col(f"{a}_{z}") + by * F.col(f"{b}_{z}") for z in ("re", "im")}
        moved = both.withColumns(move("x", "p", alpha) | move("r", "h", -alpha))
        rr, old = moved.agg(_squares("r_re", "r_im").alias("rr")).first()["rr"], rr
        state = moved.withColumns({f"p_{z}": F.col(f"r_{z}") + rr / old * F.col(f"p_{z}") for z in ("re", "im")}).drop("h_re", "h_im")
    return state.select("v", F.col("x_re").alias("re"), F.col("x_im").alias("im"))


def density_weights(nodes: DataFrame, shape: tuple[int, ...], iterations: int = 10, normalize: bool = False, **how) -> DataFrame:
    """Root weights (p, w) of sampling nodes (p, node array) by the Pipe-Menon iteration w <- w / |A A^H w|.

    Nodes are scaled to [-1/2, 1/2); A is the transform of a grid of ``shape``, cut into slabs (``how``: their bounds), so an
    iteration takes one transform to the grid and one back, all on tables, and ends with one written.
    """
    top = nodes.agg(F.max(F.array_max(F.transform("node", lambda x: F.abs(x)))).alias("m")).first()["m"]
    if top:
        nodes = nodes.select("p", F.transform("node", lambda x: x / (2 * top)).alias("node"))
    transform = SlabTransform(nodes, shape, **how)
    w = nodes.select("p", F.lit(1.0).alias("w"))
    for _ in range(iterations):
        there = transform.forward(transform.adjoint(w.select("p", F.array("w", F.lit(0.0)).alias("z"))))
        size = F.sqrt(F.col("z")[0] * F.col("z")[0] + F.col("z")[1] * F.col("z")[1])
        w = shared.cut(w.join(there, "p").select("p", (F.col("w") / F.greatest(size, F.lit(1e-300))).alias("w")))
    mean = w.agg(F.avg("w").alias("m")).first()["m"] if normalize else 1.0
    return w.select("p", F.sqrt(F.col("w") / mean).alias("w"))


def delay_rounds(voxels: DataFrame, data: DataFrame, field: DataFrame, times: DataFrame, dt: float, n_terms: int, jump: float = 3.0, iterations: int = 10,
                 unit: float = 1e-6, csm: DataFrame | None = None, weights: DataFrame | None = None) -> Iterator[tuple[float, float, float]]:
    """The rounds of ``find_delay`` without end: (step, offset after it, jump after it) of each, in ``unit`` seconds.

    Coefficients and slopes of a node are one array beside the next node's, and the times of a clock have their signal beside them: a round
    is one join.  Few voxels go to all samples (``NearOp``), which then stay where the join leaves them, unless some have no signal.
    """
    nodes = shared.Stored(_clock_nodes(field, dt, n_terms))
    coils = encode.coil_count(csm)
    rows, near = _clock_times(times, data, weights, coils), voxels.count() <= encode.NEAR
    clock = shared.Stored(rows)
    try:
        rows = clock.read()
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.min("here").alias("lo"), F.max("here").alias("hi")).first()
        if not facts["n"]:
            raise ValueError("no samples")
        if near and not rows.groupBy("p").count().where("count > 1").isEmpty():
            raise ValueError("voxels and samples must be numbered uniquely")
        near = near and facts["lo"] == facts["hi"] == coils
        if weights is not None and not rows.where("isnan(w)").isEmpty():
            raise ValueError("weights must be real numbers from 0")
        if not near:
            data = shared.cut(data)
        tau, moved = 0.0, None
        while True:
            at = rows.withColumns({"t0": F.col("t"), "t": F.col("t") + F.col("start") + tau * unit})
            both = series.interpolate_arrays(nodes.read(), at, ["shot"], dt, 2 * n_terms)
            k = {"t": F.col("t0"), "k": F.slice("value", 1, n_terms), "k_dot": F.slice("value", n_terms + 1, n_terms)}
            samples = both.select("p", *[c.alias(n) for n, c in k.items()], *(["y"] + ["w"] * (weights is not None) if near else []))
            if near:
                op = encode.NearOp(samples, voxels, n_terms, csm)
                step = op.delay_step(reconstruct(op, None, iterations=iterations), jump / unit)
                op.close()
            else:
                op = ExplicitOp(shared.cut(samples), voxels, n_terms, csm)
                image = reconstruct(op, data, weights, iterations=iterations)
                model = op.forward(image).select("p", "c", F.col("re").alias("mr"), F.col("im").alias("mi"))
                residual = data.join(model, ["p", "c"]).select("p", "c", (F.col("re") - F.col("mr")).alias("re"), (F.col("im") - F.col("mi")).alias("im"))
                step = encode.delay_step(residual, op.forward(image, derivative=True), ["p", "c"], jump / unit).first()["delta"]
            if moved is not None and np.sign(step) != np.sign(moved):
                jump = max(1.0, jump / 2)
            tau, moved = tau + step, step
            yield step, tau, jump
    finally:
        nodes.drop()
        clock.drop()


def _clock_nodes(field: DataFrame, dt: float, n_terms: int) -> DataFrame:
    """(shot, j, value, after): coefficients and their slopes in one array, and the next node's; the field has rows by term or arrays of all terms."""
    if "term" in field.columns:
        shots = field.groupBy("shot").agg(F.sort_array(F.collect_set("term")).alias("terms")).select("terms").distinct().limit(2).collect()
        if len(shots) != 1 or len(shots[0]["terms"]) < n_terms:
            raise ValueError(f"samples must have {n_terms} terms")
        value = F.array(*[F.max(F.when(F.col("term") == t, F.col("value"))) for t in shots[0]["terms"]])
        field = field.groupBy("shot", "j").agg(value.alias("value"))
    elif not field.where(F.coalesce(F.size("value") < n_terms, F.lit(True))).isEmpty():
        raise ValueError(f"samples must have {n_terms} terms")
    field = series.fir_derivatives(field, ["shot"], dt, n_terms)
    both = field.select("shot", "j", F.concat(F.slice("value", 1, n_terms), "slope").alias("value"))
    return series.with_next(both, ["shot"])


def _clock_times(times: DataFrame, data: DataFrame, weights: DataFrame | None, coils: int) -> DataFrame:
    """(shot, p, t, start, y, here[, w]): times with their signal, re and im of all coils in turn, and how many values they have of it."""
    start = F.col("start") if "start" in times.columns else F.lit(0.0)
    rows = times.select("shot", "p", "t", start.alias("start"))
    sums = [F.coalesce(F.sum(F.when(F.col("c") == c, F.col(x))), F.lit(0.0)) for c in range(coils) for x in ("re", "im")]
    whole = F.col("re").isNotNull() & F.col("im").isNotNull() & (F.col("c") >= 0) & (F.col("c") < coils)
    own = data.groupBy("p").agg(F.array(*sums).alias("y"), F.count(F.when(whole, 1)).alias("here"))
    rows = rows.join(own, "p", "left").withColumn("here", F.coalesce("here", F.lit(0)))
    if weights is None:
        return rows
    # Samples without weights have none of the sums.
    squared = weights.select("p", F.coalesce(F.col("w_re") ** 2 + F.col("w_im") ** 2, F.lit(float("nan"))).alias("w"))
    return rows.join(squared, "p", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def find_delay(voxels: DataFrame, data: DataFrame, field: DataFrame, times: DataFrame, dt: float, n_terms: int, jump: float = 3.0, least: float = 5e-3,
               iterations: int = 10, most_rounds: int = 50, unit: float = 1e-6, csm: DataFrame | None = None, weights: DataFrame | None = None) -> float:
    """Offset of the field clock, in ``unit`` seconds, from data (p, c, re, im) at times (shot, p, t[, start]).

    ``field`` (shot, j, term, value), or (shot, j, value) with arrays of all terms, holds equispaced coefficients of each shot; ``start`` is the
    offset of a shot's own clock that is known already.  Each round interpolates field and
    derivative at the present offset, reconstructs from all shots, and moves by ``jump`` times the
    least-squares step of all their residuals; the jump halves when the step changes sign.  Raises
    after ``most_rounds``.
    """
    rounds = delay_rounds(voxels, data, field, times, dt, n_terms, jump, iterations, unit, csm, weights)
    step = float("inf")
    for step, tau, jump in itertools.islice(rounds, most_rounds):
        if abs(step) <= least:
            return tau - step / jump * (jump - 1)
    raise RuntimeError(f"no convergence after {most_rounds} rounds; last step {step}")
