"""The library against dense numpy: small problems, identities, error paths."""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldweave.functions import harmonics, nufft
from fieldweave.operators import channels, encode, factors, geometry, imaging, lowrank, relations, series, solve, tallfactors, transform
from fieldweave.plans import queries
from fieldweave.sources import matfiles, nifti, roles, volumes

RNG = np.random.default_rng(5)


def problem(n_vox=14, n_samp=11, n_coil=2):
    r = RNG.uniform(-1, 1, (n_vox, 3))
    v = pd.DataFrame({"v": np.arange(n_vox), "x": r[:, 0], "y": r[:, 1], "z": r[:, 2], "b0": RNG.uniform(-25, 20, n_vox)})
    s = pd.DataFrame({"p": np.arange(n_samp), "t": np.arange(n_samp) * 1e-3})
    k, kd = RNG.normal(size=(2, n_samp, 9)) * 0.3
    csm = RNG.normal(size=(n_vox, n_coil)) + 1j * RNG.normal(size=(n_vox, n_coil))
    x = RNG.normal(size=n_vox) + 1j * RNG.normal(size=n_vox)
    return v, s, k, kd, csm, x


def frames(spark, v, s, k, kd, csm):
    vox = spark.createDataFrame(v).withColumn("b", harmonics.terms(range(1, 10))).select("v", "b0", "b")
    samp = spark.createDataFrame(s.assign(k=k.tolist(), k_dot=kd.tolist()))
    coil = spark.createDataFrame(pd.DataFrame([(i, c, z.real, z.imag) for (i, c), z in np.ndenumerate(csm)], columns=["v", "c", "re", "im"]))
    return samp, vox, coil


def basis(v):
    x, y, z = (v[c].to_numpy() for c in "xyz")
    return np.column_stack([np.ones(len(v)), x, y, z, x * y, z * y, 3 * z * z - (x * x + y * y + z * z), x * z, x * x - y * y])


def dense(v, s, k, csm):
    e = np.exp(2j * np.pi * (np.outer(s["t"], v["b0"]) + k @ basis(v).T)) / np.sqrt(len(v))
    return [e * csm[:, c] for c in range(csm.shape[1])]


def image(spark, x):
    return spark.createDataFrame(pd.DataFrame({"v": np.arange(len(x)), "re": x.real, "im": x.imag}))


def signal(df, shape):
    out = np.zeros(shape, complex)
    for r in df.collect():
        out[r["p"], r["c"]] = complex(r["re"], r["im"])
    return out


def pixels(df, n):
    out = np.zeros(n, complex)
    for r in df.collect():
        out[r["v"]] = complex(r["re"], r["im"])
    return out


@pytest.mark.parametrize("kind", ["sql", "sql-parts", "block", "blocks", "cached"])
def test_explicit_products_against_the_dense_matrix(spark, monkeypatch, kind):
    if kind == "sql-parts":
        monkeypatch.setattr(encode, "BROADCAST_BYTES", 100)
        monkeypatch.setattr(encode, "PART", 5)
    v, s, k, kd, csm, x = problem()
    samp, vox, coil = frames(spark, v, s, k, kd, csm)
    op = encode.ExplicitOp(samp, vox, 9, coil, kind.partition("-")[0] if "sql" in kind else "block", (3, 4) if kind in ("blocks", "cached") else None, kind == "cached")
    a = dense(v, s, k, csm)
    assert op.shape == (22, 14) and op.H.shape == (14, 22) and op.H.H is op
    y = signal(op.forward(image(spark, x)), (len(s), 2))
    np.testing.assert_allclose(y, np.stack([m @ x for m in a], axis=1), atol=1e-12)
    rate = 2j * np.pi * (kd @ basis(v).T)
    dy = signal(op.forward(image(spark, x), derivative=True), (len(s), 2))
    np.testing.assert_allclose(dy, np.stack([(m * rate) @ x for m in a], axis=1), atol=1e-11)
    z = RNG.normal(size=(len(s), 2)) + 1j * RNG.normal(size=(len(s), 2))
    zt = spark.createDataFrame(pd.DataFrame([(p, c, u.real, u.imag) for (p, c), u in np.ndenumerate(z)], columns=["p", "c", "re", "im"]))
    back = pixels(op.adjoint(zt), len(v))
    np.testing.assert_allclose(np.vdot(y, z), np.vdot(x, back), atol=1e-11)
    w = RNG.uniform(0, 2, len(s))
    wt = spark.createDataFrame(pd.DataFrame({"p": np.arange(len(s)), "w": w}))
    np.testing.assert_allclose(pixels(op.normal(image(spark, x), wt), len(v)), sum(m.conj().T @ (w * (m @ x)) for m in a), atol=1e-11)
    by_coil = wt.crossJoin(spark.range(2).withColumnRenamed("id", "c")).withColumn("w", F.col("w") * (1 + F.col("c")))
    np.testing.assert_allclose(pixels(op.normal(image(spark, x), by_coil), len(v)), sum((1 + c) * (m.conj().T @ (w * (m @ x))) for c, m in enumerate(a)), atol=1e-11)
    with pytest.raises(ValueError, match="weights"):
        op.normal(image(spark, x), wt.withColumn("w", F.lit(-1.0)))
    both = signal(op.mul(image(spark, x), zt, 2 - 1j, 0.5j), (len(s), 2))
    np.testing.assert_allclose(both, (2 - 1j) * y + 0.5j * z, atol=1e-11)
    np.testing.assert_allclose(pixels(op.H.mul(zt, image(spark, x), 1j, 3), len(v)), 1j * back + 3 * x, atol=1e-11)
    op.close()
    np.testing.assert_allclose(signal(op.forward(image(spark, x)), (len(s), 2)), y, atol=1e-12)


@pytest.mark.parametrize("kind", ["sql", "block", "cached"])
def test_equal_samples_and_voxels_are_multiplied_once(spark, kind):
    v, s, k, kd, csm, x = problem(14, 11)
    at, to = np.arange(56) % 14, np.arange(33) % 11  # every voxel four times, every sample three times; values and k_dot differ
    v, s, k, kd, csm = v.iloc[at].assign(v=np.arange(56)), s.iloc[to].assign(p=np.arange(33)), k[to], RNG.normal(size=(33, kd.shape[1])), RNG.normal(size=(56, 2)) + 1j * RNG.normal(size=(56, 2))
    x = RNG.normal(size=56) + 1j * RNG.normal(size=56)
    samp, vox, coil = frames(spark, v, s, k, kd, csm)
    # The phases of all rows would take 16 * 56 * 33 bytes.
    op = encode.ExplicitOp(samp, vox, 9, coil, kind.replace("cached", "block"), (2, 3) if kind == "cached" else None, kind == "cached", 16 * 14 * 11)
    assert (op._s.count, op._v.count, op.shape) == (11, 14, (66, 56))
    a = dense(v, s, k, csm)
    y = signal(op.forward(image(spark, x)), (33, 2))
    np.testing.assert_allclose(y, np.stack([m @ x for m in a], axis=1), atol=1e-11)
    rate = 2j * np.pi * (kd @ basis(v).T)
    np.testing.assert_allclose(signal(op.forward(image(spark, x), derivative=True), (33, 2)), np.stack([(m * rate) @ x for m in a], axis=1), atol=1e-10)
    w = RNG.uniform(0, 2, 33)
    wt = spark.createDataFrame(pd.DataFrame({"p": np.arange(33), "w": w}))
    np.testing.assert_allclose(pixels(op.normal(image(spark, x), wt), 56), sum(m.conj().T @ (w * (m @ x)) for m in a), atol=1e-10)
    some = image(spark, x).where("v % 3 = 0")
    np.testing.assert_allclose(signal(op.forward(some), (33, 2)), np.stack([m[:, ::3] @ x[::3] for m in a], axis=1), atol=1e-11)
    op.close()


def test_slices_are_as_many_with_more_suppliers(spark, tmp_path):
    n = np.arange(7000)
    pd.DataFrame({"s_suppkey": n, "s_nationkey": n * 7 % 25}).to_parquet(tmp_path / "supplier.parquet")
    got = queries.extract_geometries(spark, str(tmp_path)).orderBy("slice").collect()
    want = [(i, (i * 7 % 25 % 5 * 3 + i * 1e-5) / 1000) for i in range(5)]
    assert [r["slice"] for r in got] == [i for i, _ in want]
    np.testing.assert_allclose([r["x"] for r in got], [x for _, x in want], atol=1e-9)


def test_explicit_operators_refuse_what_cannot_be(spark):
    v, s, k, kd, csm, _ = problem()
    samp, vox, coil = frames(spark, v, s, k, kd, csm)
    for args, what in [((samp, vox, 10), "terms"), ((samp, vox, 16), "16 terms"), ((samp, vox.where("v < 0"), 9), "voxels"), ((samp.where("p < 0"), vox, 9), "samples"),
                       ((samp, vox.union(vox), 9), "uniquely"), ((samp, vox, 9, coil, "gpu"), "implementation"), ((samp, vox, 9, coil, "sql", None, True), "cached"),
                       ((samp, vox, 9, coil, "block", (0, 1)), "block"), ((samp, vox, 9, coil, "block", None, True, 1000), "bytes")]:
        with pytest.raises(ValueError, match=what):
            encode.ExplicitOp(*args)


def test_reconstruction_is_the_weighted_least_squares_solution(spark):
    v, s, k, kd, csm, x = problem(6, 15)
    samp, vox, coil = frames(spark, v, s, k, kd, csm)
    a = np.concatenate(dense(v, s, k, csm))
    y = a @ x + 0.1 * RNG.normal(size=len(a))
    w = RNG.uniform(0.5, 1.5, len(s))
    data = spark.createDataFrame(pd.DataFrame({"p": np.tile(s["p"], 2), "c": np.repeat([0, 1], len(s)), "re": y.real, "im": y.imag}))
    wt = spark.createDataFrame(pd.DataFrame({"p": s["p"], "w_re": w, "w_im": 0 * w}))
    got = pixels(solve.reconstruct(encode.ExplicitOp(samp, vox, 9, coil), data, wt, iterations=8), len(v))
    ww = np.tile(w, 2)[:, None]
    np.testing.assert_allclose(got, np.linalg.lstsq(ww * a, ww[:, 0] * y, rcond=None)[0], atol=1e-6)


def test_maps_are_one_row_a_voxel_and_meet_sums_of_all_coils(spark):
    v, s, k, kd, csm, x = problem(6, 15)
    samp, vox, coil = frames(spark, v, s, k, kd, csm)
    op = encode.ExplicitOp(samp, vox, 9, coil)
    a = dense(v, s, k, csm)
    y = RNG.normal(size=(len(a), len(s))) + 1j * RNG.normal(size=(len(a), len(s)))
    rows = [(int(p), c, float(y[c, i].real), float(y[c, i].imag)) for c in range(len(a)) for i, p in enumerate(s["p"])]
    image = op.adjoint(spark.createDataFrame(rows, "p long, c int, re double, im double"))
    assert op._coil_maps().count() == len(v)
    plan = image._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(v#" in line and ", c#" in line.split("hashpartitioning")[1]]
    np.testing.assert_allclose(pixels(image, len(v)), sum(m.conj().T @ z for m, z in zip(a, y, strict=True)), atol=1e-9)


def test_a_clock_offset_is_found(spark):
    n, dt = 60, 1e-5
    j = np.arange(n)
    v, *_ = problem(8)
    terms = np.zeros((n, 9))
    terms[:, 1], terms[:, 2] = 3 * np.sin(j / 6), 3 * np.cos(j / 7)
    field = spark.createDataFrame(pd.DataFrame([(0, i, l, terms[i, l]) for i in j for l in range(9)], columns=["shot", "j", "term", "value"]))
    t = np.arange(4, 52) * dt
    truth = 2.5e-6
    k = np.column_stack([np.interp(t + truth, j * dt, terms[:, l]) for l in range(9)])
    x = RNG.normal(size=8) + 1j * RNG.normal(size=8)
    v["b0"] = 0.0
    y = (np.exp(2j * np.pi * (k @ basis(v).T)) / np.sqrt(8)) @ x
    data = spark.createDataFrame(pd.DataFrame({"p": np.arange(len(t)), "c": 0, "re": y.real, "im": y.imag}))
    times = spark.createDataFrame(pd.DataFrame({"shot": 0, "p": np.arange(len(t)), "t": t}))
    vox = spark.createDataFrame(v).withColumn("b", harmonics.terms(range(1, 10))).select("v", "b0", "b")
    got = solve.find_delay(vox, data, field, times, dt, 9, jump=1.0, least=0.05, iterations=12)
    assert abs(got - 2.5) < 0.3


@pytest.mark.parametrize("weighted", [False, True])
def test_rounds_where_voxels_go_to_all_samples_equal_those_of_blocks(spark, monkeypatch, weighted):
    v, s, k, kd, csm, x = problem(6, 15)
    _, vox, coil = frames(spark, v, s, k, kd, csm)
    curve = np.cumsum(RNG.normal(size=(2, 10, 9)) * 0.1, axis=1)
    field = spark.createDataFrame([(u, j, t, float(curve[u, j, t])) for u in range(2) for j in range(10) for t in range(9) if j != 4], "shot int, j int, term int, value double")
    times = spark.createDataFrame([(u, u * 100 + j, (j + 0.25) * 1e-5, u * 1e-6) for u in range(2) for j in range(10)], "shot int, p long, t double, start double")
    y = RNG.normal(size=(20, 4))
    data = spark.createDataFrame([(u * 100 + j, c, float(y[u * 10 + j, 2 * c]), float(y[u * 10 + j, 2 * c + 1])) for u in range(2) for j in range(10) for c in range(2)], "p long, c int, re double, im double")
    weights = times.where("p != 103").select("p", (0.5 + F.col("p") % 3).alias("w_re"), F.lit(0.25).alias("w_im")) if weighted else None

    def first():
        rounds = solve.delay_rounds(vox, data, field, times, 1e-5, 9, iterations=1, csm=coil, weights=weights)
        return next(rounds)

    near = first()
    samples = spark.createDataFrame([(int(p), 0.1, [0.5] * 9, [1.0, 0.0] * 2) for p in range(12)], "p long, t double, k array<double>, y array<double>")
    op = encode.NearOp(samples, vox, 9, coil)
    plan = op.normal(image(spark, x))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "SortMergeJoin" not in plan[plan.index("BroadcastNestedLoopJoin") :].split("BroadcastExchange")[0]
    op.close()
    monkeypatch.setattr(encode, "NEAR", 0)
    np.testing.assert_allclose(near, first(), rtol=1e-7)


def test_compression_sums_where_all_rows_of_a_key_are(spark):
    data = spark.createDataFrame([(p, c, float(p + c), float(p - c)) for p in range(20) for c in range(3)], "p long, c int, re double, im double")
    matrix = spark.createDataFrame([(c, o, float(c + 1), float(o)) for c in range(3) for o in range(2)], "c int, out int, re double, im double")
    out = channels.apply_compression(data, matrix, ["p"])
    want = {(p, o): sum(complex(p + c, p - c) * complex(c + 1, o) for c in range(3)) for p in range(20) for o in range(2)}
    assert {(r.p, r.c): complex(r.re, r.im) for r in out.collect()} == want
    plan = channels.apply_compression(data, matrix, ["p"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning")


def features(spark, n=53, q=3, rows=(9, 12)):
    g = RNG.normal(size=(n, q)) * 0.05
    f = [RNG.normal(size=(m, q)) for m in rows]
    table = spark.createDataFrame(pd.DataFrame({"v": np.arange(n), "g": g.tolist()}))
    return table, g, f


def whole(df, n, rank):
    out = np.zeros((n, rank), complex)
    rows = df.toPandas()
    out[rows["v"]] = factors.unpack(rows["s"])
    return out


@pytest.mark.parametrize("finalize", ["gram", "svd"])
def test_randomised_factors_approach_the_best_rank(spark, finalize):
    table, g, f = features(spark)
    h = factors.phase_block(f[1], g)
    q, s = factors.rsvd(table, f[1], 6, 4, finalize=finalize)
    best = np.sqrt((np.linalg.svd(h)[1][6:] ** 2).sum())
    assert np.linalg.norm(h - q @ whole(s, 53, 6).conj().T) < 1.3 * best + 1e-8
    again, _ = factors.rsvd(table.repartition(7), f[1], 6, 4, finalize=finalize)
    np.testing.assert_allclose(np.abs(np.linalg.svd(q.conj().T @ again)[1]), 1, atol=1e-6)
    with pytest.raises(ValueError, match="exceed"):
        factors.rsvd(table, f[0], 9, 5)


def test_shared_basis_meets_its_tolerance_or_raises(spark):
    table, g, f = features(spark)
    cut = lambda df: df
    us, coeff, s = factors.shared_factors(table, f, 6, tol=0.02, oversample=3, cut=cut)
    q = factors.assemble(us, coeff)
    basis_ = whole(s, 53, q.shape[1])
    np.testing.assert_allclose(basis_.conj().T @ basis_, np.eye(q.shape[1]), atol=1e-8)
    assert factors.orthogonality(s, q.shape[1]) < 1e-7
    h = np.concatenate([factors.phase_block(x, g) for x in f])
    exact = np.linalg.norm(h - q @ basis_.conj().T) / np.linalg.norm(h)
    assert abs(exact - factors.relative_error(table, s, np.concatenate(f), q)) < 1e-9 and exact < 0.2
    last = whole(factors.readout_factor(s, coeff[1]), 53, 6)
    np.testing.assert_allclose(us[1] @ last.conj().T, q[len(f[0]) :] @ basis_.conj().T, atol=1e-9)
    # A readout that the basis holds already adds nothing.
    twice = factors.shared_factors(table, [f[0], f[0]], 6, tol=0.02, oversample=3, cut=cut)
    assert twice[1][1].shape[0] == factors.shared_factors(table, f[:1], 6, tol=0.02, oversample=3, cut=cut)[1][0].shape[0]
    with pytest.raises(ValueError, match="allowed"):
        factors.shared_factors(table, f, 6, tol=1e-6, most=7, oversample=3, cut=cut)
    q2, s2, tail = factors.recompress(q, s, tol=0.1)
    lost = np.linalg.norm(q @ basis_.conj().T - q2 @ whole(s2, 53, q2.shape[1]).conj().T) / np.linalg.norm(q @ basis_.conj().T)
    assert abs(lost - tail) < 1e-8 and tail <= 0.1
    for how in (dict(), dict(tol=0.1, rank=2), dict(rank=99), dict(tol=-1.0)):
        with pytest.raises(ValueError):
            factors.recompress(q, s, **how)


def test_weighted_recompression_is_best_in_its_metric(spark):
    table, g, f = features(spark)
    us, coeff, s = factors.shared_factors(table, f, 6, tol=0.02, oversample=3, cut=lambda df: df)
    q = factors.assemble(us, coeff)
    w, u = RNG.uniform(0, 2, 53), RNG.uniform(0, 2, len(q))
    w[:5] = 0
    weighted = s.join(spark.createDataFrame(pd.DataFrame({"v": np.arange(53), "w": w})), "v")
    q2, s2, tail = factors.recompress(q, weighted, rank=4, time_weight=u, weight="w")
    root = np.sqrt(factors.normalized_weights(u, len(q)))[:, None], np.sqrt(factors.normalized_weights(w, 53))
    m = root[0] * (q @ whole(s, 53, q.shape[1]).conj().T) * root[1]
    left = root[0] * (q2 @ whole(s2, 53, 4).conj().T) * root[1]
    best = np.sqrt((np.linalg.svd(m, compute_uv=False)[4:] ** 2).sum())
    assert abs(np.linalg.norm(m - left) - best) < 1e-8 and abs(tail - best / np.linalg.norm(m)) < 1e-8
    for bad in (w - 1, 0 * w, w + 1j, w[:3]):
        with pytest.raises(ValueError, match="weights"):
            factors.normalized_weights(bad, 53)


def test_stacked_triangles_keep_small_singular_values(spark):
    u, v = np.linalg.qr(RNG.normal(size=(3000, 6)))[0], np.linalg.qr(RNG.normal(size=(6, 6)))[0]
    values = 10.0 ** -np.arange(0, 12, 2)
    x = (u * values @ v).astype(complex)
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(factors.pack(x))], "v long, s array<double>").repartition(5)
    np.testing.assert_allclose(np.linalg.svd(factors.triangle(table, "s", 6), compute_uv=False), values, rtol=1e-4)
    np.testing.assert_allclose(factors.coefficient_spectrum(x)[0], values, rtol=1e-4)


def test_factors_of_every_readout(spark):
    table, g, f = features(spark)
    q, s = factors.per_readout(table, f, 9, 0)
    kept = factors.per_readout(table, f, 9, 0, keep_bytes=16 * 9 * 53)[1]
    for source in (s, kept):
        for d, (a, b) in enumerate([(0, 9), (9, 21)]):
            own = whole(source.where(F.col("d") == d).drop("d"), 53, 9)
            h = factors.phase_block(f[d], g)
            error = np.linalg.norm(h - q[a:b] @ own.conj().T) / np.linalg.norm(h)
            assert error < (1e-10 if d == 0 else 0.2)


def test_sampled_bases_are_checked_on_other_voxels(spark):
    table, g, f = features(spark, 300, rows=(30, 30, 30, 30))
    q, s, report = factors.sampled_shared(table, f, 10, 2, samples=80, tol=1e-3, oversample=4)
    assert len(report["readouts"]) == 2 and report["phase_check"]["held_out"] and report["condition"] < 100
    h = np.concatenate([factors.phase_block(x, g) for x in f])
    exact = np.linalg.norm(h - q @ whole(s, 300, q.shape[1]).conj().T) / np.linalg.norm(h)
    assert abs(exact - report["phase_check"]["error"]) < 0.1 and exact < 0.2
    with pytest.raises(ValueError, match="cannot"):
        factors.sampled_shared(table, f, 10, 2, samples=3, oversample=4)
    with pytest.raises(ValueError, match="choose"):
        factors.sampled_shared(table, f, 10, 9, oversample=4)


def test_snapshots_stand_for_all_rows(spark):
    table, g, f = features(spark, 200, rows=(33,) * 5)
    rows, weights, held = factors.snapshot_selection(table, f, 8, 3)
    assert len(held) == 1 and len(set(rows.tolist())) == len(rows) == 8 and weights.sum() == 4 * 3
    assert all(r // 33 not in held and (r % 33) in (0, 16, 32) for r in rows)
    s, facts = factors.snapshot_space(table, np.concatenate(f), rows, 6, weights)
    assert facts["rank"] == 6 and factors.orthogonality(s, 6) < 1e-9
    check, audit, disjoint = factors.sample_rows([33] * 5, 1)
    assert disjoint and all(not set(a) & set(b) and set(a) <= set(range(33 * d, 33 * d + 33)) for d, (a, b) in enumerate(zip(check, audit, strict=True)))
    assert factors.sample_rows([2, 2], 1)[2] is False


def test_joint_bases_pass_their_audit_or_are_none(spark):
    table, g, f = features(spark, 400, rows=(40, 40, 40, 40))
    q, s, report = factors.joint_basis(table, f, tol=0.2, samples=100, every=4)
    assert report["passed"] and report["audit"] <= 0.2 and report["disjoint_times"]
    for d, x in enumerate(f):
        h = factors.phase_block(x, g)
        assert np.linalg.norm(h - q[40 * d : 40 * d + 40] @ whole(s, 400, q.shape[1]).conj().T) / np.linalg.norm(h) < 0.3
    assert factors.joint_basis(table, f, tol=1e-9, snapshots=4)[0] is None
    for ordering in ("snapshot", "coefficients"):
        q, s, _ = factors.fixed_basis(table, f, 6, 10, ordering, samples=64)
        assert q.shape[1] == 6 and factors.relative_error(table, s, np.concatenate(f), q) < 0.6
    with pytest.raises(ValueError, match="ordering"):
        factors.fixed_basis(table, f, 6, 10, "none")


def test_the_diagnostic_tells_space_from_fit(spark):
    table, g, f = features(spark, 300)
    rows = np.concatenate(f)
    q, s = factors.rsvd(table, rows, 8, 4)
    found = factors.projection_diagnostic(table, s, rows, q)
    assert abs(found["defect"]) < 1e-10 and found["fit"] < found["space"]
    off = factors.projection_diagnostic(table, s, rows, q + 0.1)
    assert off["fit"] > 1.5 * found["fit"] and abs(off["space"] - found["space"]) < 1e-9
    assert factors.expansion(off | {"space": 1.0, "fit": 2.0}, 0.1, 9, 9, 9) == "fit" and factors.expansion(None, 0.1, 9, 9, 9) == "fit"
    far = {"space": 1.0, "fit": 0.1}
    assert factors.expansion(far, 0.1, 20, 9, 9) == "parent" and factors.expansion(far, 0.1, 9, 9, 9) == "snapshots"


@pytest.mark.parametrize("kernel", ["gridding", "separable"])
@pytest.mark.parametrize("shape", [(7,), (12, 13), (5, 4, 3), (8, 1)])
def test_transforms_against_the_dense_matrix(kernel, shape):
    nodes, x, y = RNG.uniform(-1.3, 1.3, (40, len(shape))), RNG.normal(size=shape) + 1j * RNG.normal(size=shape), RNG.normal(size=40) + 1j * RNG.normal(size=40)
    grid = np.stack(np.meshgrid(*[np.arange(n) - n // 2 for n in shape], indexing="ij"), -1).reshape(-1, len(shape))
    a, t = np.exp(2j * np.pi * nodes @ grid.T), nufft.KERNELS[kernel](nodes, shape)
    np.testing.assert_allclose(t.forward(x), a @ x.ravel(), atol=1e-10)
    np.testing.assert_allclose(t.adjoint(y).ravel(), a.conj().T @ y, atol=1e-10)
    with pytest.raises(ValueError, match="nodes"):
        nufft.KERNELS[kernel](nodes, (*shape, 2))


def lowrank_problem(spark, shape, n_samp=9, readouts=2):
    nx, ny, nz = shape
    spacing = (0.8, 1.3, 1.0)
    at = np.array([(ix, iy, iz) for iz in range(nz) for iy in range(ny) for ix in range(nx)])
    keep = np.ones(len(at), bool)
    keep[[0, -1]] = False
    xyz = (at - (np.array(shape) - 1) / 2) * spacing
    v = pd.DataFrame({"v": np.arange(len(at)), "ix": at[:, 0], "iy": at[:, 1], "iz": at[:, 2], "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "b0": RNG.uniform(-25, 20, len(at))})[keep]
    s = pd.DataFrame({"p": np.arange(n_samp * readouts), "d": np.repeat(np.arange(readouts), n_samp), "t": np.tile(np.arange(n_samp) * 1e-3, readouts)})
    k = RNG.normal(size=(len(s), 9)) * np.array([0.1, 0.2, 0.2, 0.2 if nz > 1 else 0.05, *[0.01] * 5])
    csm = RNG.normal(size=(len(v), 2)) + 1j * RNG.normal(size=(len(v), 2))
    vox = spark.createDataFrame(v).withColumn("b", harmonics.terms(range(1, 10)))
    samp = spark.createDataFrame(s.assign(k=k.tolist()))
    coil = spark.createDataFrame(pd.DataFrame([(int(v["v"].iloc[i]), c, z.real, z.imag) for (i, c), z in np.ndenumerate(csm)], columns=["v", "c", "re", "im"]))
    return v, s, k, csm, vox, samp, coil, spacing


@pytest.mark.parametrize(("shape", "how"), [
    ((6, 5, 1), dict(options=lowrank.Options(method="per_readout", rank=9, oversample=0))),
    ((4, 5, 3), dict(options=lowrank.Options(rank=9, oversample=0, tol=1e-12), kernel="separable", coils=2, ranks=3)),
    ((4, 5, 3), dict(options=lowrank.Options(method="per_readout", rank=9, oversample=0, keep_bytes=10**6), ranks=4)),
    ((7, 5, 3), dict(options=lowrank.Options(method="per_readout", rank=9, oversample=0), kernel="gridding", cells=13, hold_bytes=0, coils=1)),
])
def test_lowrank_products_against_the_dense_matrix(spark, shape, how):
    v, s, k, csm, vox, samp, coil, spacing = lowrank_problem(spark, shape)
    op, a = lowrank.LowRankOp(samp, vox, shape, spacing, csm=coil, **how), dense(v, s, k, csm)
    tol = dict(atol=1e-9)
    assert op.shape == (36, len(v)) and op.H.shape == (len(v), 36)
    x = RNG.normal(size=len(v)) + 1j * RNG.normal(size=len(v))
    xt = spark.createDataFrame(pd.DataFrame({"v": v["v"].to_numpy(), "re": x.real, "im": x.imag}))
    y = signal(op.forward(xt), (len(s), 2))
    np.testing.assert_allclose(y, np.stack([m @ x for m in a], axis=1), **tol)
    z = RNG.normal(size=(len(s), 2)) + 1j * RNG.normal(size=(len(s), 2))
    zt = spark.createDataFrame(pd.DataFrame([(p, c, u.real, u.imag) for (p, c), u in np.ndenumerate(z)], columns=["p", "c", "re", "im"]))
    back = pixels(op.adjoint(zt), int(v["v"].max()) + 1)[v["v"]]
    np.testing.assert_allclose(np.vdot(y, z), np.vdot(x, back), atol=1e-9)
    w = RNG.uniform(0, 2, len(s))
    wt = spark.createDataFrame(pd.DataFrame({"p": s["p"], "w": w}))
    plain = pixels(op.normal(xt, wt), int(v["v"].max()) + 1)[v["v"]]
    np.testing.assert_allclose(plain, sum(m.conj().T @ (w * (m @ x)) for m in a), **tol)
    if not op.own:
        np.testing.assert_allclose(pixels(op.normal(xt, wt, by="channel"), int(v["v"].max()) + 1)[v["v"]], plain, atol=1e-9)
        with pytest.raises(ValueError, match="readout"):
            op.normal(xt, wt, by="readout")
    else:
        np.testing.assert_allclose(pixels(op.normal(xt, wt, by="readout"), int(v["v"].max()) + 1)[v["v"]], plain, atol=1e-9)
    normal = op.normal_operator(wt)
    assert op.normal_operator(wt) is normal
    with pytest.raises(ValueError, match="release"):
        op.normal_operator()
    op.release()
    with pytest.raises(ValueError, match="released"):
        normal.forward(xt)
    made = []
    assert lowrank.rebuild(op, lambda: made.append(1) or op) is op and made and op.normal_operator() is not normal


def test_weights_of_normal_products(spark):
    p = spark.createDataFrame([(3,), (1,)], "p long")
    table = lambda rows: spark.createDataFrame(rows, "p long, c int, w double")
    assert lowrank.normal_weights(None, p, 2) is None
    assert lowrank.normal_weights(table([(1, 0, 2.0), (3, 0, 5.0), (1, 1, 2.0), (3, 1, 5.0)]), p, 2).orderBy("p").collect() == [(1, 2.0), (3, 5.0)]
    assert lowrank.normal_weights(table([(1, 0, 2.0), (3, 0, 5.0)]).drop("c"), p, 2).orderBy("p").collect() == [(1, 2.0), (3, 5.0)]
    for bad, what in [([(1, 0, 2.0), (3, 0, -5.0)], "every coil"), ([(1, 0, 2.0), (3, 0, 5.0), (1, 1, 2.0), (3, 1, 4.0)], "same"), ([(1, 0, -2.0), (3, 0, 5.0), (1, 1, -2.0), (3, 1, 5.0)], "from 0"),
                      ([(1, 0, 2.0), (1, 1, 2.0)], "from 0")]:
        with pytest.raises(ValueError, match=what):
            lowrank.normal_weights(table(bad), p, 2)


@pytest.mark.parametrize("bad", [
    dict(method="none"), dict(strategy="global"), dict(method="direct_shared", strategy="none"), dict(rank=0), dict(rank=30), dict(tol=0.0),
    dict(method="direct_shared", strategy="global"), dict(method="direct_shared", strategy="global", eps=2.0), dict(method="direct_shared", strategy="global", eps=0.1, roi_tol=0.1),
    dict(eps=0.1), dict(roi_tol=0.1), dict(recompress_tol=0.1, recompress_rank=2), dict(recompress_tol=-0.1), dict(recompress_rank=0), dict(method="per_readout", recompress_tol=0.1),
    dict(method="direct_shared", recompress_rank=3), dict(weights=np.ones(3)), dict(coil_weighting=True), dict(method="per_readout", fit_samples=5), dict(fit_samples=0),
    dict(readout_count=1), dict(fit_samples=5, readout_count=9), dict(keep_bytes=5), dict(method="per_readout", keep_bytes=-1),
])
def test_options_that_do_not_go_together(bad):
    with pytest.raises(ValueError):
        lowrank.Options(**bad).check(4, 30)
    lowrank.Options(method="direct_shared", strategy="global", eps=0.1).check(4, 30)


def test_failures_name_their_phase(spark):
    with pytest.raises(RuntimeError, match="fit of readout 3: no"), lowrank.phase(spark, "fit of readout 3"):
        raise ValueError("no")


def test_adaptive_factors_pass_their_audit_or_are_none(spark):
    table, g, f = features(spark, 400)
    rows = np.concatenate(f)
    q, s, report = factors.adaptive_factors(table, f, 0.3, snapshots=1, samples=32, parent=4, most=16, step=4, every=2)
    assert q is not None and report[-1]["rank"] == q.shape[1] and len(report) > 1
    assert {r["cause"] for r in report[:-1]} <= {"fit", "parent", "snapshots"}
    assert np.linalg.norm(factors.phase_block(rows, g) - q @ whole(s, 400, q.shape[1]).conj().T) / np.sqrt(400 * len(rows)) < 0.32
    assert factors.adaptive_factors(table, rows, 1e-9, snapshots=4, samples=16, parent=4, most=4, most_snapshots=4, most_samples=16)[0] is None


def test_paired_errors_draw_from_all_voxels(spark):
    table, g, f = features(spark, 5000)
    rows = np.concatenate(f)
    places, count = factors.numbered(table)
    assert count == 5000 and sorted(r.j for r in places.collect()) == list(range(5000))
    # The factors are wrong in the one half of the voxels that a small pool in hash order would leave out.
    order = [r.v for r in table.select("v").orderBy(F.xxhash64("v"), "v").collect()]
    bad = set(order[2048:])
    basis = spark.createDataFrame([(v, [0.0, 0.0] if v in bad else [1.0, 0.0]) for v in order], "v long, s array<double>")
    q = np.ones((len(rows), 1), complex)
    s = np.array([0.0 if v in bad else 1.0 for v in range(5000)])
    exact = (np.abs(factors.phase_block(rows, g) - s) ** 2).mean()
    _, loss, error = factors.paired_errors(rows, q, table, basis, 1, 20_000)[0]
    assert abs(loss - exact) < 5 * error


def test_covariance_whitening_and_compression(spark):
    x = RNG.normal(size=(101, 3)) + 1j * RNG.normal(size=(101, 3))
    rows = spark.createDataFrame(pd.DataFrame([(o, c, z.real, z.imag) for (o, c), z in np.ndenumerate(x)], columns=["obs", "c", "re", "im"]))
    cov = channels.collected(channels.covariance(rows), 3)
    m = x - x.mean(axis=0)
    np.testing.assert_allclose(cov, m.conj().T @ m / 100, atol=1e-12)
    w = channels.whitening(cov, 2.0)
    np.testing.assert_allclose(w.conj().T @ cov @ w, 2 * np.eye(3), atol=1e-12)
    gram = np.diag([4.0, 3, 1, 0.1]) ** 2
    fit = channels.fit_compression(gram, energy=0.9)
    assert fit.matrix.shape[1] == 2 and abs(fit.retained - 25 / 26.01) < 1e-12
    for bad in (dict(), dict(count=2, energy=0.5), dict(count=9)):
        with pytest.raises(ValueError):
            channels.fit_compression(gram, **bad)
    with pytest.raises(ValueError, match="definite"):
        channels.whitening(-np.eye(2))
    with pytest.raises(ValueError, match="positive"):
        channels.bandwidth_scale(1.0, 0.0)


def shots(spark, values):
    return spark.createDataFrame(pd.DataFrame({"u": 0, "j": np.arange(len(values)), "value": np.asarray(values, float)}))


def test_series_identities(spark):
    values = RNG.normal(size=20)
    s = shots(spark, values)
    got = series.cumulative_trapezoid(s, ["u"], 0.1).orderBy("j").toPandas()["integral"]
    np.testing.assert_allclose(got, np.concatenate([[0], np.cumsum((values[1:] + values[:-1]) * 0.05)]), atol=1e-12)
    t = spark.createDataFrame(pd.DataFrame({"u": 0, "t": [0.0, 0.05, 1.9, 1.93, -0.1]}))
    for f in (series.interpolate_linear, series.interpolate_akima):
        out = {r["t"]: r["value"] for r in f(s, t, ["u"], 0.1).collect()}
        assert abs(out[0.0] - values[0]) < 1e-9 and out[-0.1] == 0 and out[1.93] == 0
    straight = series.interpolate_akima(shots(spark, np.arange(9) * 2.0), spark.createDataFrame([(0, 0.33)], "u int, t double"), ["u"], 0.1).first()["value"]
    assert abs(straight - 6.6) < 1e-9
    fir = series.fir_derivative(s, ["u"], 0.1).orderBy("j").toPandas()["slope"]
    np.testing.assert_allclose(fir, np.convolve(values, np.array([1 / 8, 1 / 4, 0, -1 / 4, -1 / 8]) / 0.1, "same"), atol=1e-9)


def test_response_of_one_copies_its_input(spark):
    g = RNG.normal(size=(13, 3))
    waves = spark.createDataFrame(pd.DataFrame([(0, i, j, g[j, i]) for j in range(13) for i in range(3)], columns=["wave", "i", "j", "value"]))
    one = np.ones((15, 3, 1)) * np.eye(3)[None, :, :1]
    out = series.apply_response(waves, one + 0j).orderBy("j").toPandas()
    np.testing.assert_allclose(out["value"], g[:, 0], atol=1e-12)
    assert [series.smooth_length(n) for n in (7, 11, 121)] == [8, 12, 125]


def test_terms_and_order_selection(spark):
    row = spark.createDataFrame([(2.0, 3.0, 5.0)], "x double, y double, z double").select(harmonics.terms(range(1, 10)).alias("b")).first()["b"]
    assert row == [1, 2, 3, 5, 6, 15, 37, 10, -5]
    with pytest.raises(ValueError):
        harmonics.term(37)
    with pytest.raises(ValueError):
        harmonics.select_orders(F.col("k"), F.col("n"), 9, "1011")


def test_geometry_round_trips(spark, tmp_path):
    geo = geometry.Geometry("siemens", (0.2, 0.1, 0.05), (4, 3, 2), "FFDL", (0.1, 0.2, -0.3))
    assert geometry.Geometry.from_dict(geo.to_dict()) == geo
    grid = geometry.Grid((4, 3, 2), (1.0, 2.0, 3.0), exchange_xy=True)
    assert geometry.Grid.from_dict(grid.to_dict()) == grid
    volume = RNG.normal(size=(4, 3, 2)).astype(np.float32)
    m = nifti.write(volume, geo, str(tmp_path / "x.nii.gz"))
    back, again = nifti.read(str(tmp_path / "x.nii.gz"))
    np.testing.assert_array_equal(back, volume)
    np.testing.assert_array_equal(again, m)
    table = geometry.rps_grid(spark, geo).select("v", "ix", "iy", "iz", F.col("v").cast("double").alias("x"))
    same = geometry.resample(table.select("ix", "iy", "iz", "x"), geo, {1: geo}).toPandas()
    np.testing.assert_allclose(same["x"], same["v"], atol=1e-6)
    merged = geometry.merge_geometries([geometry.Geometry("GE", (0.2, 0.2, 0.005), (8, 8, 1), t_pcs=(0, 0, z)) for z in (0.01, 0.0, 0.005)])
    assert merged.matrix == (8, 8, 3) and abs(merged.fov[2] - 0.015) < 1e-12 and merged.t_pcs == (0, 0, 0.005)
    with pytest.raises(ValueError, match="rotation"):
        geometry.Geometry("GE", (1, 1, 1), (1, 1, 1), "FFS")
    with pytest.raises(ValueError, match="method"):
        geometry.merge_slabs(table, 8, 3)


def test_metrics_and_their_guards(spark):
    x, ref = RNG.normal(size=(2, 9)) + 1j * RNG.normal(size=(2, 9))
    df = spark.createDataFrame(pd.DataFrame({"re": x.real, "im": x.imag, "ref_re": ref.real, "ref_im": ref.imag}))
    m = imaging.metrics(df).first()
    scale = np.vdot(x, ref) / np.vdot(x, x)
    assert abs(complex(m["scale_re"], m["scale_im"]) - scale) < 1e-12
    assert abs(m["aligned_nrmse"] - np.linalg.norm(scale * x - ref) / np.linalg.norm(ref)) < 1e-10
    assert abs(m["nrmse"] - np.linalg.norm(x - ref) / np.linalg.norm(ref)) < 1e-12
    with pytest.raises(Exception, match="finite"):
        imaging.metrics(df.withColumn("re", F.lit(float("nan")))).collect()
    a = RNG.normal(size=(16, 16))
    assert abs(imaging.ssim(a * np.exp(0.3j), a) - 1) < 1e-12 and imaging.ssim(1.5 * a, a) < 1
    with pytest.raises(ValueError):
        imaging.ssim(a, 0 * a)
    z = RNG.normal(size=(6, 5)) + 1j
    np.testing.assert_allclose(imaging.centered_fft(imaging.centered_fft(z, (0, 1)), (0, 1), inverse=True), z, atol=1e-12)


def test_centre_window_fixed_and_as_established(spark):
    df = spark.createDataFrame(pd.DataFrame([(0, i, j, 1.0 + i + 8 * j) for i in range(8) for j in range(8)], columns=["n", "i", "j", "x"]))
    same = imaging.center_window(df, (8, 8), (8, 8), ["n"])
    assert same.agg(F.sum("x")).first()[0] == df.agg(F.sum("x")).first()[0]
    assert imaging.center_window(df, (8, 8), (8, 4), ["n"], compat=True).agg(F.sum("x")).first()[0] == 0


def test_density_weights_are_normalised(spark):
    t = np.linspace(0, 1, 37)
    nodes = np.column_stack([t * np.cos(20 * t), t * np.sin(20 * t)])
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(nodes)], "p long, node array<double>")
    w = solve.density_weights(frame, (8, 8), iterations=3, normalize=True, held=18 * 16, samples=10).toPandas().sort_values("p")["w"].to_numpy()
    grid = np.stack(np.meshgrid(np.arange(-4, 4), np.arange(-4, 4), indexing="ij"), -1).reshape(-1, 2)
    a = np.exp(2j * np.pi * (nodes / (2 * np.abs(nodes).max())) @ grid.T)
    want = np.ones(37)
    for _ in range(3):
        want = want / np.abs(a @ (a.conj().T @ want))
    np.testing.assert_allclose(w, np.sqrt(want / want.mean()), rtol=1e-9)
    assert abs((w**2).mean() - 1) < 1e-12 and w[-1] > w[1]


@pytest.mark.parametrize(("shape", "columns", "held", "samples"), [((70, 6), 2, 17 * 16 * 2, 5), ((9,), 1, 1, 1000), ((12, 5, 4), 2, 1, 7)])
def test_slab_transforms_against_the_dense_matrix(spark, shape, columns, held, samples):
    nodes = RNG.uniform(-1.3, 1.3, (60, len(shape)))
    nodes[:20] *= 0.01  # a crowded slab is spread in parts
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(nodes)], "p long, node array<double>")
    t = transform.SlabTransform(frame, shape, columns, held=held, samples=samples)
    # No task holds more than a small part of the grid.
    assert t.slabs >= t.fine[0] // 2 and (samples > 60 or max(t.parts) > 1)
    grid = np.stack(np.meshgrid(*[np.arange(n) - n // 2 for n in shape], indexing="ij"), -1).reshape(-1, len(shape))
    a = np.exp(2j * np.pi * nodes @ grid.T)
    x, y = (RNG.normal(size=(n, columns)) + 1j * RNG.normal(size=(n, columns)) for n in (len(grid), 60))
    rows = lambda z, name: spark.createDataFrame([(i, r.view(float).tolist()) for i, r in enumerate(z)], f"{name} long, z array<double>")
    values = lambda df, name: np.stack(df.toPandas().sort_values(name)["z"].to_numpy()).view(complex)
    np.testing.assert_allclose(values(t.forward(rows(x, "cell")), "p"), a @ x, atol=1e-10)
    np.testing.assert_allclose(values(t.adjoint(rows(y, "p")), "cell"), a.conj().T @ y, atol=1e-10)
    if columns == 2:  # missing values are 0
        np.testing.assert_allclose(values(t.forward(rows(x, "cell").where("cell >= 5")), "p"), a[:, 5:] @ x[5:], atol=1e-10)


def test_stacks_are_written_in_the_order_of_their_numbers(tmp_path):
    at = lambda z: geometry.Geometry("GE", (0.2, 0.2, 0.004), (4, 3, 1), t_pcs=(0, 0, z))
    x = RNG.normal(size=(4, 3, 3)).astype(np.float32)
    m = nifti.write_stack(x, [at(0.02), at(0.0), at(0.01)], [3, 1, 2], str(tmp_path / "s.nii.gz"))
    back, again = nifti.read(str(tmp_path / "s.nii.gz"))
    np.testing.assert_array_equal(back, x[:, :, [1, 2, 0]])
    assert abs(np.linalg.norm(m[:, 2]) - 10) < 1e-4 and np.allclose(m, again) and abs(m[2, 3]) < 1e-6
    nifti.write_complex_stack(x + 1j, [at(0.0), at(0.01), at(0.02)], [1, 2, 3], str(tmp_path / "c"))
    np.testing.assert_allclose(nifti.read(str(tmp_path / "c_mag.nii.gz"))[0], np.hypot(x, 1), rtol=1e-6)
    with pytest.raises(ValueError, match="one slice"):
        nifti.write_stack(x, [at(0.0)], [1], str(tmp_path / "e.nii.gz"))


def test_library_does_not_import_the_corpus_operators():
    import subprocess
    import sys

    code = "import fieldweave.registry, sys; print(any(m.startswith('fieldweave.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent)).stdout.strip() == "False"


def test_geometries_as_rows_agree_with_geometries_as_objects(spark):
    turn = ((0.0, 0.0, 1.0), (0.6, 0.8, 0.0), (-0.8, 0.6, 0.0))
    kinds = [("SIEMENS", p) for p in geometry.PATIENT_TO_DEVICE] + [("ge", "HFS"), ("Philips", "HFS"), ("UIH", "HFS")]
    objects = [geometry.Geometry(v, (0.2, 0.1, 0.004), (8, 4, 1), p, tuple(RNG.normal(size=3).tolist()), turn) for v, p in kinds]
    schema = "g long, i long, vendor string, position string, fov array<double>, matrix array<int>, t_pcs array<double>, r_rps_pcs array<array<double>>"
    table = lambda rows: spark.createDataFrame(rows, schema)
    row = lambda g, i, x: (g, i, x.vendor, x.position, list(x.fov), list(x.matrix), [float(t) for t in x.t_pcs], [list(r) for r in x.r_rps_pcs])
    geos = table([row(g, 0, x) for g, x in enumerate(objects)])
    points = spark.createDataFrame([(g, *RNG.normal(size=6).tolist()) for g in range(len(objects))], "g long, x double, y double, z double, gx double, gy double, gz double")
    for space in ("PCS", "DCS"):
        there = relations.placed(points, geos, ["g"], space)
        back = {r.g: (r.x, r.y, r.z) for r in relations.placed(there, geos, ["g"], space, back=True).collect()}
        got, turned = {r.g: r for r in there.collect()}, {r.g: r for r in relations.rotated(points, geos, ["g"]).collect()}
        for p in points.collect():
            r, t = objects[p.g].frame(space)
            np.testing.assert_allclose([got[p.g].x, got[p.g].y, got[p.g].z], r @ [p.x, p.y, p.z] + t, atol=1e-12)
            np.testing.assert_allclose(back[p.g], [p.x, p.y, p.z], atol=1e-12)
            m = np.array(objects[p.g].r_rps_dcs) * geometry.NOMINAL_SIGN[objects[p.g].vendor]
            np.testing.assert_allclose([turned[p.g].gx, turned[p.g].gy, turned[p.g].gz], m @ [p.gx, p.gy, p.gz], atol=1e-12)
    again = relations.rotated(relations.rotated(points, geos, ["g"]), geos, ["g"], back=True).join(points.select("g", F.col("gx").alias("o")), "g")
    assert again.where("abs(gx - o) > 1e-12").isEmpty()
    stack = [geometry.Geometry("GE", (0.2, 0.1, 0.004), (8, 4, 1), "HFS", tuple(0.005 * i * np.array(turn)[:, 2]), turn) for i in (2, 0, 3, 1)]
    want = geometry.merge_geometries(stack)
    one = relations.merged(table([row(0, i, x) for i, x in enumerate(stack)]), ["g"], "i").first()
    np.testing.assert_allclose([*one.fov, *one.t_pcs], [*want.fov, *want.t_pcs], atol=1e-12)
    assert tuple(one.matrix) == want.matrix
    slabs = [geometry.Geometry("GE", (0.2, 0.1, 0.016), (8, 4, 8), "HFS", tuple(0.012 * i * np.array(turn)[:, 2]), turn) for i in range(3)]
    want = geometry.merged_slabs_geometry(slabs, 18)
    one = relations.merged_slabs(table([row(0, i, x) for i, x in enumerate(slabs)]), ["g"], "i", 18).first()
    np.testing.assert_allclose([*one.fov, *one.t_pcs], [*want.fov, *want.t_pcs], atol=1e-12)
    other = geometry.Geometry("GE", (0.2, 0.1, 0.004), (8, 4, 1), "HFS", (0.0, 0.0, 0.0))
    for bad, why in ((stack[:3], "evenly"), ([stack[0], other], "aligned")):
        with pytest.raises(Exception, match=why):
            relations.merged(table([row(0, i, x) for i, x in enumerate(bad)]), ["g"], "i").collect()
    for bad in (("XX", "HFS"), ("ge", "FFP"), ("siemens", "none")):
        with pytest.raises(Exception, match="no rotation"):
            relations.with_frames(geos.limit(1).withColumns({"vendor": F.lit(bad[0]), "position": F.lit(bad[1])})).collect()


@pytest.mark.parametrize(("rows", "width", "blocks"), [(300, 5, 40), (60, 7, 20), (3, 5, 2), (50, 4, 1)])
def test_tall_tables_are_orthogonalised_by_a_tree(spark, monkeypatch, rows, width, blocks):
    monkeypatch.setattr(tallfactors, "FAN", 3)
    x = RNG.normal(size=(rows, width)) + 1j * RNG.normal(size=(rows, width))
    if width == 7:
        x[:, 3] = x[:, 1] * 2  # columns may depend on each other
    at = np.sort(RNG.integers(0, blocks, rows))
    table = spark.createDataFrame([(int(b), np.flatnonzero(at == b).astype(np.int64).tobytes(), x[at == b].tobytes()) for b in np.unique(at)], "sb int, ps binary, x binary")
    q, r = tallfactors.orthogonal(table, "sb", blocks, width)
    out = np.zeros((rows, len(r)), complex)
    for row in q.collect():
        out[np.frombuffer(row.ps, np.int64)] = np.frombuffer(row.x, complex).reshape(-1, len(r))
    np.testing.assert_allclose(out.conj().T @ out, np.eye(len(r)), atol=1e-12)
    np.testing.assert_allclose(out @ r, x, atol=1e-12)


def test_factors_with_both_sides_as_tables(spark, monkeypatch):
    monkeypatch.setattr(tallfactors, "SAMPLES", 7)
    monkeypatch.setattr(tallfactors, "VOXELS", 50)
    table, g, f = features(spark, 200, rows=(40,))
    samples = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(f[0])], "p long, f array<double>")
    exact = factors.phase_block(f[0], g)
    best = np.linalg.svd(exact, compute_uv=False)
    for rank in (3, 40):
        q, basis = tallfactors.rsvd(table, samples, rank, min(5, 40 - rank))
        qs = np.stack(q.toPandas().sort_values("p")["q"].to_numpy()).view(complex)
        np.testing.assert_allclose(qs.conj().T @ qs, np.eye(rank), atol=1e-10)
        error = np.linalg.norm(exact - qs @ whole(basis, 200, rank).conj().T) / np.linalg.norm(exact)
        assert abs(tallfactors.relative_error(table, samples, q, basis) - error) < 1e-10
        assert error <= 1.5 * np.sqrt((best[rank:] ** 2).sum()) / np.linalg.norm(exact) + 1e-9
    with pytest.raises(ValueError, match="rank"):
        tallfactors.rsvd(table, samples, 39, 5)


def test_table_factors_at_full_rank_lose_nothing_and_are_made_in_several_tasks(spark):
    f, g = RNG.uniform(0, 1, (300, 2)), RNG.uniform(-0.7, 0.7, (400, 2))
    samples = spark.createDataFrame(pd.DataFrame({"p": np.arange(300), "f": f.tolist()}))
    table = spark.createDataFrame(pd.DataFrame({"v": np.arange(400), "g": g.tolist()}))
    q, basis = tallfactors.rsvd(table, samples, None)
    qs = np.stack(q.toPandas().sort_values("p")["q"].to_numpy()).view(complex)
    rank, exact = qs.shape[1], factors.phase_block(f, g)
    assert rank < 200  # singular values fall below what doubles can tell
    # Squared singular values (a Gram matrix) would tell half as many digits.
    assert np.linalg.norm(exact - qs @ whole(basis, 400, rank).conj().T) < 1e-12 * np.linalg.norm(exact)
    for by, most in (("sb", 300), ("vb", 400)):
        left, n = tallfactors._blocks(samples, "p", "f", most, "sb")
        right, m = tallfactors._blocks(table, "v", "g", most, "vb")
        pairs = tallfactors._pairs(left, right, n if by == "sb" else m, by)
        assert pairs.count() == n * m > 1 and pairs.select(F.spark_partition_id()).distinct().count() > 1


def copied_features(spark, n=60, rows=(21, 30)):
    """Voxels of 20 kinds and samples of 7 for each readout, both shuffled; and the same, each kind once."""
    g = (RNG.normal(size=(20, 3)) * 0.05)[np.arange(n) % 20]
    f = [RNG.normal(size=(7, 3))[RNG.permutation(m) % 7] for m in rows]
    table = spark.createDataFrame(pd.DataFrame({"v": np.arange(n), "g": g.tolist()}))
    place = np.cumsum([0, *rows])
    samples = spark.createDataFrame([(d, int(place[d] + i), x.tolist()) for d in range(len(f)) for i, x in enumerate(f[d])], "d long, p long, f array<double>")
    return table, samples, g, f


def test_factors_of_copies_are_those_of_all_rows(spark):
    table, samples, g, f = copied_features(spark)
    voxels = factors.distinct_voxels(table)
    names, reps, rows = factors.rows_by_readout(samples)
    assert names == [0, 1] and [len(r) for r in rows] == [21, 30] and all(r.f.shape == (7, 3) for r in rows) and voxels.count() == 20
    for r, x in zip(rows, f, strict=True):
        np.testing.assert_array_equal(r.f[r.at], x)
    every, at = np.concatenate(f), np.arange(60) % 20
    h, joined = factors.phase_block(every, g), factors.Rows.joined(rows)
    expand = lambda s, rank: whole(s, 20, rank)[at]
    assert factors.full_rank(voxels, joined) == 14
    q, s = factors.rsvd(voxels, joined, 14, 2)
    qs, ss = q[joined.at], expand(s, 14)
    np.testing.assert_allclose(qs.conj().T @ qs, np.eye(14), atol=1e-6)
    np.testing.assert_allclose(qs @ ss.conj().T, h, atol=1e-9)
    low, ls = factors.rsvd(voxels, joined, 4)
    error = np.linalg.norm(h - low[joined.at] @ expand(ls, 4).conj().T) / np.linalg.norm(h)
    assert abs(factors.relative_error(voxels, ls, joined, low) - error) < 1e-9 and error < 1.3 * np.sqrt((np.linalg.svd(h)[1][4:] ** 2).sum()) / np.linalg.norm(h) + 1e-9
    us, coeff, basis_ = factors.shared_factors(voxels, rows, 7, 1e-9)
    assert factors.orthogonality(basis_, coeff[0].shape[0]) < 1e-6
    shared_q = factors.assemble(us, coeff)
    np.testing.assert_allclose(shared_q[joined.at] @ expand(basis_, coeff[0].shape[0]).conj().T, h, atol=1e-6)
    w, u = RNG.uniform(1, 2, 60), RNG.uniform(0.5, 2, 51)
    means = spark.createDataFrame(pd.DataFrame({"v": np.arange(20), "w": w.reshape(3, 20).mean(axis=0)}))
    q2, s2, tail = factors.recompress(low, ls.join(means, "v"), rank=2, time_weight=u, weight="w", rows=joined)
    root = np.sqrt(u / u.mean())[:, None], np.sqrt(w / w.mean())
    m = root[0] * (low[joined.at] @ expand(ls, 4).conj().T) * root[1]
    lost = np.linalg.norm(m - root[0] * (q2[joined.at] @ expand(s2, 2).conj().T) * root[1]) / np.linalg.norm(m)
    assert abs(lost - tail) < 1e-8
    places, count = factors.numbered(voxels)
    got = places.toPandas()
    assert count == 60 and sorted(got["j"]) == list(range(60)) and (got["v"].value_counts() == 3).all()
    exact = (np.abs(h - low[joined.at] @ expand(ls, 4).conj().T) ** 2).mean()
    _, loss, spread_ = factors.paired_errors(joined, low, voxels, ls, 1, 20_000)[-1]
    assert abs(loss - exact) < 5 * spread_
    plain, own = factors.snapshot_selection(table, f, 5, 3, 4), factors.snapshot_selection(voxels, rows, 5, 3, 4)
    np.testing.assert_allclose(np.sort(joined.f[own[0]], axis=0), np.sort(every[plain[0]], axis=0))
    assert sorted(own[1]) == sorted(plain[1]) and own[1].sum() == plain[1].sum()


def test_tall_factors_of_copies(spark):
    table, samples, g, f = copied_features(spark)
    every, at = np.concatenate(f), np.arange(60) % 20
    voxels, _ = tallfactors.classes(table, "v", "g")
    own, members = tallfactors.classes(samples.select("p", "f"), "p", "f")
    assert voxels.count() == 20 and own.count() == 14 and members.count() == 51
    rep = dict(members.collect())
    h = factors.phase_block(every, g)
    for rank in (4, None):
        q, s = tallfactors.rsvd(voxels, own, rank)
        z = {r.p: np.array(r.q).view(complex) for r in q.collect()}
        qs = np.stack([z[rep[i]] for i in range(51)])
        np.testing.assert_allclose(qs.conj().T @ qs, np.eye(qs.shape[1]), atol=1e-6)
        error = np.linalg.norm(h - qs @ whole(s, 20, qs.shape[1])[at].conj().T) / np.linalg.norm(h)
        assert abs(tallfactors.relative_error(voxels, own, q, s) - error) < 1e-9 and (error < 1e-9 or rank)


@pytest.mark.parametrize("how", ["per_readout", "shared", "tables", "no maps"])
def test_lowrank_products_of_copies(spark, how):
    v, s, k, csm, vox, samp, coil, spacing = lowrank_problem(spark, (4, 5, 3))
    n, m = len(v), len(s)
    # Every voxel three times with maps of its own, every sample twice in its readout.
    v3, s2, k2 = pd.concat([v.assign(v=v["v"] + 1000 * i) for i in range(3)]), pd.concat([s, s.assign(p=s["p"] + m)]), np.concatenate([k, k])
    csm3 = RNG.normal(size=(3 * n, 2)) + 1j * RNG.normal(size=(3 * n, 2))
    vox3 = vox.crossJoin(spark.range(3)).withColumn("v", F.col("v") + 1000 * F.col("id")).drop("id")
    samp2 = samp.crossJoin(spark.range(2)).withColumn("p", F.col("p") + m * F.col("id")).drop("id")
    ids = v3["v"].to_numpy()
    maps = spark.createDataFrame(pd.DataFrame([(int(ids[i]), c, z.real, z.imag) for (i, c), z in np.ndenumerate(csm3)], columns=["v", "c", "re", "im"]))
    if how == "no maps":
        maps, csm3 = None, np.ones((3 * n, 1))
    more = {"tables": dict(tables=lambda g, f: tallfactors.rsvd(g, f, None)), "shared": dict(options=lowrank.Options(rank=9, oversample=0, tol=1e-12))}
    op = lowrank.LowRankOp(samp2, vox3, (4, 5, 3), spacing, csm=maps, **more.get(how, dict(options=lowrank.full_options(vox3, samp2, 9, False, method="per_readout"))))
    assert op.shape == (2 * m * csm3.shape[1], 3 * n) and (op._v.count, op._s.count) == (n, m)
    a = dense(v3, s2, k2, csm3)
    x = RNG.normal(size=3 * n) + 1j * RNG.normal(size=3 * n)
    xt = spark.createDataFrame(pd.DataFrame({"v": ids, "re": x.real, "im": x.imag}))
    y = signal(op.forward(xt), (2 * m, csm3.shape[1]))
    np.testing.assert_allclose(y, np.stack([b @ x for b in a], axis=1), atol=1e-6)
    w = RNG.uniform(0, 2, 2 * m)
    wt, want = spark.createDataFrame(pd.DataFrame({"p": np.arange(2 * m), "w": w})), sum(b.conj().T @ (w * (b @ x)) for b in a)
    for by in ("rank", "readout") if op.own else ("rank", "channel"):
        np.testing.assert_allclose(pixels(op.normal(xt, wt, by=by), int(ids.max()) + 1)[ids], want, atol=1e-6)
        np.testing.assert_allclose(pixels(op.normal(xt, by=by), int(ids.max()) + 1)[ids], sum(b.conj().T @ (b @ x) for b in a), atol=1e-6)
    op.close()


def test_factors_of_single_readouts_are_made_where_blocks_meet(spark):
    v, s, k, csm, vox, samp, coil, spacing = lowrank_problem(spark, (4, 5, 3))
    op = lowrank.LowRankOp(samp, vox, (4, 5, 3), spacing, csm=coil, options=lowrank.full_options(vox, samp, 9, False, method="per_readout"))
    assert "feat" in op._voxel_blocks().columns and "s" not in op._voxel_blocks().columns  # features travel, not factors
    x = RNG.normal(size=len(v)) + 1j * RNG.normal(size=len(v))
    xt = spark.createDataFrame(pd.DataFrame({"v": v["v"].to_numpy(), "re": x.real, "im": x.imag}))
    held = signal(op.forward(xt), (len(s), csm.shape[1]))  # the third product: factors are written
    assert op._blocks is not None and "s" in op._blocks.read().columns
    op.close()
    op._products = 0
    made = signal(op.forward(xt), (len(s), csm.shape[1]))
    assert op._blocks is None
    np.testing.assert_allclose(made, held, atol=1e-10)
    np.testing.assert_allclose(made, np.stack([b @ x for b in dense(v, s, k, csm)], axis=1), atol=1e-6)


def test_sums_of_rows_are_those_of_all_voxels(spark):
    table, g, f = features(spark, 50, rows=(40,))
    x = RNG.normal(size=(50, 3))
    for edges in (factors.row_edges(40), [0, 20, 40], [0, 40]):
        got = factors.summed_rows(table, lambda part, a, b: factors.times(f[0][a:b], factors.spatial(part), x[np.asarray(part["v"])]), edges, 3)  # noqa: B023
        np.testing.assert_allclose(got, factors.phase_block(f[0], g) @ x, atol=1e-12)


@pytest.mark.parametrize("shape", [(10, 7, 3), (40, 40), (5, 1, 2)])
def test_windows_on_small_grids_are_matrix_products(monkeypatch, shape):
    nodes = RNG.uniform(-0.5, 0.5, (60, len(shape)))
    transform, exact = nufft.Gridding(nodes, shape), nufft.Separable(nodes, shape)
    small = transform._small()
    assert small == (shape != (40, 40))
    if small:  # no column goes through its windows cell by cell
        monkeypatch.setattr(nufft.Gridding, "_parts", None)
    x, y = (RNG.normal(size=(n, 5)) + 1j * RNG.normal(size=(n, 5)) for n in (int(np.prod(shape)), 60))
    np.testing.assert_allclose(transform.forward_many(x), exact.forward_many(x), atol=1e-9)
    np.testing.assert_allclose(transform.adjoint_many(y), exact.adjoint_many(y), atol=1e-9)


def test_windows_are_computed_once_for_all_coils_and_ranks(monkeypatch):
    calls, windows = [], nufft.windows
    monkeypatch.setattr(nufft, "windows", lambda *a: calls.append(len(a[0])) or windows(*a))
    m, n, rank = 30, 40, 4
    node, cell = RNG.uniform(-0.5, 0.5, (m, 2)), RNG.integers(0, 48, n)
    z = lambda *shape: RNG.normal(size=shape) + 1j * RNG.normal(size=shape)
    q, s, x = z(m, rank), z(n, rank), z(n, 1)
    grid = np.stack(np.meshgrid(np.arange(-3, 3), np.arange(-4, 4), indexing="ij"), -1).reshape(-1, 2)
    exact = np.exp(2j * np.pi * node @ grid.T)[:, cell] * (q @ s.conj().T)
    pair = lowrank.Pair(lambda row, m: (nufft.Gridding(np.frombuffer(row["node"]).reshape(m, 2), (6, 8)), np.ones(m)), 3, 2)
    counts = []
    for coils in (1, 5):
        maps, y = z(n, coils), z(m, coils)
        row = {k: v.tobytes() for k, v in {"node": node, "cell": cell.astype(float), "q": q, "s": s, "m": maps, "x": x, "y": y}.items()}
        calls.clear()
        np.testing.assert_allclose(pair.signals(row, m, n), exact @ (x * maps), atol=1e-9)
        np.testing.assert_allclose(pair.images(row, m, n)[:, 0], (maps.conj() * (exact.conj().T @ y)).sum(axis=1), atol=1e-9)
        counts.append(sum(calls))
    assert counts[0] == counts[1] == 2 * 2 * m


def test_volumes_are_written_and_read_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(volumes, "BATCH", 50)
    shape, path = (7, 5, 9), str(tmp_path / "v.nii.gz")
    x = RNG.normal(size=315).astype(np.float32)
    x[[0, 3, *range(100, 260), 314]] = 0
    x[5] = np.nan
    frame = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(x.tolist()) if v != 0], "cell long, value double").repartition(3)
    m = np.array([[2.0, 0, 0, -6], [0, 3, 0, -6], [0, 0, 4, 1]])
    volumes.write_volume(frame, path, shape, m, tasks=4)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["v.nii.gz"]
    with gzip.open(path) as f:
        data = f.read()
    np.testing.assert_array_equal(np.frombuffer(data[352:], "<f4"), x)
    assert data[:348] == bytes(nifti_head(x.reshape(shape, order="F"), m, tmp_path))
    for slices, file in ((0, path), (2, str(tmp_path / "plain.nii")), (0, str(tmp_path / "one.nii.gz"))):
        if "plain" in file:
            (tmp_path / "plain.nii").write_bytes(data)
        if "one" in file:
            (tmp_path / "one.nii.gz").write_bytes(gzip.compress(data))
        back = volumes.read_volume(spark, file, slices)
        assert back.rdd.getNumPartitions() >= {path: 4, str(tmp_path / "plain.nii"): 5}.get(file, 1)
        rows = back.toPandas().sort_values("cell")
        np.testing.assert_array_equal(rows["value"].to_numpy(np.float32), x)
        assert (rows["ix"] + 7 * rows["iy"] + 35 * rows["iz"] == rows["cell"]).all()
    for bad in ([(3, 1.0), (3, 2.0)], [(315, 1.0)]):
        with pytest.raises(Exception, match="each once"):
            volumes.write_volume(spark.createDataFrame(bad, "cell long, value double"), str(tmp_path / "bad.nii.gz"), shape, m)
    volumes.write_volume(frame.limit(0), str(tmp_path / "none.nii.gz"), shape, m)
    assert volumes.read_volume(spark, str(tmp_path / "none.nii.gz")).where("value = 0").count() == 315
    assert not [p for p in tmp_path.iterdir() if "bad" in p.name or "parts" in p.name]
    (tmp_path / "wrong.nii").write_bytes(b"no")
    with pytest.raises(Exception, match="NIfTI"):
        volumes.read_volume(spark, str(tmp_path / "wrong.nii")).count()


def nifti_head(x, m, folder):
    """The header that the other writer makes."""
    path = str(folder / "other.nii.gz")
    nifti._save(x, m.astype(np.float32), path)
    with gzip.open(path) as f:
        head = bytearray(f.read(348))
    (folder / "other.nii.gz").unlink()
    return head


def mat_bytes(variables, compressed, order="<"):
    """A MAT-file of version 5, written by hand."""
    kinds = {"f8": (9, 6), "f4": (7, 7), "i2": (3, 10), "u1": (2, 9), "i4": (5, 12)}

    def element(kind, data):
        if len(data) <= 4 and len(data):
            return struct.pack(order + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
        return struct.pack(order + "II", kind, len(data)) + data + bytes(-len(data) % 8)

    out = b"made by hand".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI")
    for name, (x, kind) in variables.items():
        code, cls = kinds.get(kind, (4, 4))
        numbers = [x.real, x.imag] if np.iscomplexobj(x) else [x]
        body = element(6, struct.pack(order + "II", cls | 0x800 * (len(numbers) == 2), 0)) + element(5, struct.pack(f"{order}{x.ndim}i", *x.shape)) + element(1, name.encode())
        body += b"".join(element(code, np.asarray(n, order + kind).tobytes(order="F")) for n in numbers)
        whole = struct.pack(order + "II", 14, len(body)) + body
        packed = zlib.compress(whole)
        out += struct.pack(order + "II", 15, len(packed)) + packed if compressed else whole
    return out


@pytest.mark.parametrize(("compressed", "order"), [(False, "<"), (True, "<"), (False, ">"), (True, ">")])
def test_variables_of_mat_files_are_read_by_ranges(spark, tmp_path, monkeypatch, compressed, order):
    monkeypatch.setattr(matfiles, "BATCH", 64)
    monkeypatch.setattr(matfiles, "PIECE", 100)
    folder = "/root/testdata/sf0.001"
    csm = roles.coils(spark, folder).toPandas().sort_values(["c", "v"])
    b0 = roles.voxels(spark, folder).toPandas().sort_values("v")["b0"].to_numpy()
    maps = (csm["re"] + 1j * csm["im"]).to_numpy().reshape(5, -1).T
    variables = {
        "gre_csm": (maps, "f8"), "gre_b0": (b0.reshape(10, 20, order="F"), "f4"), "gre_mask": ((b0 > 0).reshape(10, 4, 5, order="F").astype(np.uint8), "u1"),
        "label": (np.array([[65, 66]]), "u2"), "dt": (np.array([[7]]), "i2"), "z": (np.array([[1 - 2j]]), "i2"), "none": (np.zeros((0, 3)), "f8"), "k": (np.arange(300).reshape(3, 100) - 5, "i4"),
    }
    path = str(tmp_path / "scan.mat")
    with open(path, "wb") as f:
        f.write(mat_bytes(variables, compressed, order))
    rows = matfiles.read_mat(spark, path, cells=100)
    assert rows.rdd.getNumPartitions() >= (6 if compressed else 18)
    found = {n: part.sort_values("cell") for n, part in rows.toPandas().groupby("name")}
    assert set(found) == set(variables) - {"label", "none"}
    for name, part in found.items():
        x, kind = variables[name]
        assert list(part["dims"].iloc[0]) == list(x.shape)
        np.testing.assert_array_equal(part["re"].to_numpy() + 1j * part["im"].to_numpy(), np.asarray(x, "c16" if kind != "f4" else "f4").ravel(order="F"))
    one = matfiles.axes(matfiles.read_mat(spark, path, "gre_mask"), "ix", "iy", "iz").toPandas()
    assert (variables["gre_mask"][0][one["ix"], one["iy"], one["iz"]] == one["re"]).all() and len(one) == 200
    for bad, why in ((b"short", "version 5"), (mat_bytes(variables, compressed, order)[:-9], "ends|early|element")):
        with open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(Exception, match=why):
            matfiles.read_mat(spark, path).count()
