"""The registered queries over the fixture tables and their oracles.

Floating results are snapped to a grid (floor(x * 10^n + 1/2) / 10^n), which both engines compute
alike.  ``ORACLES`` has SQL for every query that SQL can express; the others return error figures
that tests hold against dense numpy.
"""

from __future__ import annotations

import itertools
import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import cplx, harmonics
from ..functions.cplx import snapped
from ..operators import channels as ch
from ..operators import encode, factors, geometry, imaging, lowrank, relations, series, solve, tallfactors
from ..sources import roles, volumes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TAU = 2 * math.pi


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(x: str, digits: int = 6) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits})"


def rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({n: snapped(F.col(n), digits) for n in names})


# ------------------------------------------------------------------ grids and geometry

GRID = geometry.Grid((24, 18, 5), (0.5, 0.25, 2.0))
GEO = geometry.Geometry("siemens", (0.24, 0.18, 0.01), (24, 18, 5), "HFDR", (0.125, -0.25, 0.5), ((0.0, 0.0, 1.0), (0.6, 0.8, 0.0), (-0.8, 0.6, 0.0)))


#: The grid that the parts fill: 20 by 20 cells, and as many planes as it takes.
_PART_GRID = "SELECT p_partkey AS v, d, p_partkey % 20 AS ix, p_partkey // 20 % 20 AS iy, p_partkey // 400 AS iz FROM part, (SELECT max(p_partkey) // 400 + 1 AS d FROM part) m"


def _part_grid(spark, sf_dir) -> tuple[tuple[int, int, int], DataFrame]:
    """The shape of that grid, and the cells that are parts."""
    parts = roles.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"))
    return (20, 20, parts.agg(F.max("v").alias("m")).first()["m"] // 400 + 1), parts


@query(f"""SELECT v, ix::INT AS ix, iy::INT AS iy, iz::INT AS iz, {r('(ix - 9.5e0) * 0.5e0')} AS x, {r('(iy - 9.5e0) * 0.25e0')} AS y, {r('(iz - (d - 1) / 2e0) * 2e0')} AS z FROM ({_PART_GRID}) t""")
def grid_coords(spark, sf_dir):
    shape, parts = _part_grid(spark, sf_dir)
    return rounded(geometry.Grid(shape, GRID.spacing).table(spark).join(parts, "v"), ["x", "y", "z"])


@query(f"""SELECT v, {r('((400 * d - 1 - v) // 20 % 20 - 9.5e0) * 0.25e0')} AS x, {r('(ix - 9.5e0) * 0.5e0')} AS y, {r('(iz - (d - 1) / 2e0) * 2e0')} AS z FROM ({_PART_GRID}) t""")
def grid_exchanged_reversed(spark, sf_dir):
    shape, parts = _part_grid(spark, sf_dir)
    g = geometry.Grid(shape, GRID.spacing, exchange_xy=True, reverse=(True, False, False))
    return rounded(g.table(spark).join(parts, "v").select("v", "x", "y", "z"), ["x", "y", "z"])


_RPS = f"SELECT v, (ix - 9.5e0) * 0.012e0 AS a, (iy - 9.5e0) * 0.009e0 AS b, (iz - (d - 1) / 2e0) * (0.01e0 / d) AS c FROM ({_PART_GRID}) t"


@query(f"""SELECT v, {r('c + 0.125e0')} AS x, {r('0.6e0 * a + 0.8e0 * b - 0.25e0')} AS y, {r('-0.8e0 * a + 0.6e0 * b + 0.5e0')} AS z,
 {r('0.6e0 * a + 0.8e0 * b - 0.25e0')} AS dx, {r('c + 0.125e0')} AS dy, {r('0.8e0 * a - 0.6e0 * b - 0.5e0')} AS dz FROM ({_RPS}) q""")
def rps_grid_affine(spark, sf_dir):
    shape, parts = _part_grid(spark, sf_dir)
    geo = geometry.Geometry(GEO.vendor, GEO.fov, shape, GEO.position, GEO.t_pcs, GEO.r_rps_pcs)
    rps = geometry.rps_grid(spark, geo).join(parts, "v").select("v", "x", "y", "z")
    dcs = geometry.to_space(rps, geo, "DCS").withColumnsRenamed({"x": "dx", "y": "dy", "z": "dz"})
    return rounded(geometry.to_space(rps, geo, "PCS").join(dcs, "v"), ["x", "y", "z", "dx", "dy", "dz"])


@query(f"SELECT v, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z FROM ({roles.VOX_SQL}) q")
def rps_roundtrip(spark, sf_dir):
    vox = roles.voxels(spark, sf_dir).select("v", "x", "y", "z")
    for space in ("PCS", "DCS"):
        vox = geometry.from_space(geometry.to_space(vox, GEO, space), GEO, space)
    return rounded(vox, ["x", "y", "z"])


#: Every position of the one vendor that has them all, and the others' only one.
_FRAMES = [("SIEMENS", p) for p in geometry.PATIENT_TO_DEVICE] + [(v, "HFS") for v in geometry.NOMINAL_SIGN if v != "SIEMENS"]
_TURNS = ", ".join(f"({n}, '{v}', '{p}', {', '.join(f'{x}e0' for row in geometry.PATIENT_TO_DEVICE[p] for x in row)}, {geometry.NOMINAL_SIGN[v]}e0)" for n, (v, p) in enumerate(_FRAMES))


@query(f"""WITH t(n, vendor, position, a, b, c, d, e, f, g, h, i, s) AS (VALUES {_TURNS}), q AS (SELECT s_suppkey, s_acctbal / 1000 AS x, {roles.D('s_suppkey')} * 0.25e0 AS y,
 s_nationkey - 12e0 AS z, {roles.D('s_nationkey')} AS p, t.* FROM supplier JOIN t ON s_suppkey % {len(_FRAMES)} = n)
SELECT s_suppkey, vendor, position, {r('a * x + b * y + c * z')} AS tx, {r('d * x + e * y + f * z')} AS ty, {r('g * x + h * y + i * z')} AS tz,
 {r('s * (p * (b * 0.6e0 + c * -0.8e0) + 5 * (b * 0.8e0 + c * 0.6e0) + 7 * a)')} AS gx, {r('s * (p * (e * 0.6e0 + f * -0.8e0) + 5 * (e * 0.8e0 + f * 0.6e0) + 7 * d)')} AS gy,
 {r('s * (p * (h * 0.6e0 + i * -0.8e0) + 5 * (h * 0.8e0 + i * 0.6e0) + 7 * g)')} AS gz FROM q""")
def geometry_frames(spark, sf_dir):
    """Suppliers as geometries of every vendor and position: offsets and one gradient each in device axes."""
    s = roles.read(spark, sf_dir, "supplier")
    pick = lambda at: F.array(*[F.lit(f[at]) for f in _FRAMES])[(F.col("s_suppkey") % len(_FRAMES)).cast("int")]
    geos = s.select(
        "s_suppkey", pick(0).alias("vendor"), pick(1).alias("position"),
        F.array(F.col("s_acctbal") / 1000, F.col("s_suppkey") * 0.25, F.col("s_nationkey") - 12.0).alias("t_pcs"), relations.rows_of(GEO.r_rps_pcs).alias("r_rps_pcs"),
    )
    offsets = relations.with_frames(geos).select("s_suppkey", "vendor", "position", *[F.col("t_dcs")[i].alias(f"t{c}") for i, c in enumerate("xyz")])
    nominal = s.select("s_suppkey", F.col("s_nationkey").cast("double").alias("gx"), F.lit(5.0).alias("gy"), F.lit(7.0).alias("gz"))
    return rounded(offsets.join(relations.rotated(nominal, geos, ["s_suppkey"]), "s_suppkey"), ["tx", "ty", "tz", "gx", "gy", "gz"])


@query(f"""WITH g AS (SELECT n_nationkey, n_nationkey * 0.125e0 AS tx, n_regionkey - 2e0 AS ty FROM nation)
SELECT v, {r('z + tx')} AS x, {r('0.6e0 * x + 0.8e0 * y + ty')} AS y, {r('-0.8e0 * x + 0.6e0 * y + 0.5e0')} AS z FROM ({roles.VOX_SQL}) q JOIN g ON v % 25 = n_nationkey""")
def placed_in_geometries(spark, sf_dir):
    """Every voxel in the patient coordinates of its nation's geometry; there and back again changes nothing."""
    n = roles.read(spark, sf_dir, "nation")
    geos = n.select(F.col("n_nationkey").alias("g"), F.lit("siemens").alias("vendor"), F.lit("FFP").alias("position"),
                    F.array(F.col("n_nationkey") * 0.125, F.col("n_regionkey") - 2.0, F.lit(0.5)).alias("t_pcs"), relations.rows_of(GEO.r_rps_pcs).alias("r_rps_pcs"))
    vox = roles.voxels(spark, sf_dir).select("v", (F.col("v") % 25).cast("int").alias("g"), "x", "y", "z")
    there = relations.placed(vox, geos, ["g"], "DCS")
    out = relations.placed(relations.placed(there, geos, ["g"], "DCS", back=True), geos, ["g"], "PCS")
    return rounded(out.select("v", "x", "y", "z"), ["x", "y", "z"])


_GRAD = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS gx, l_discount AS gy, l_tax AS gz FROM lineitem"


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r('-(0.6e0 * gx + 0.8e0 * gy)')} AS gx, {r('-gz')} AS gy,
 {r('-(0.8e0 * gx - 0.6e0 * gy)')} AS gz FROM ({_GRAD}) q""")
def gradient_rotate(spark, sf_dir):
    rows = roles.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity AS gx", "l_discount AS gy", "l_tax AS gz")
    return rounded(geometry.rotate_gradients(rows, GEO), ["gx", "gy", "gz"])


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r('gx')} AS gx, {r('gy')} AS gy, {r('gz')} AS gz FROM ({_GRAD}) q")
def gradient_roundtrip(spark, sf_dir):
    rows = roles.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity AS gx", "l_discount AS gy", "l_tax AS gz")
    return rounded(geometry.rotate_gradients(geometry.rotate_gradients(rows, GEO), GEO, back=True), ["gx", "gy", "gz"])


@query("""WITH q AS (SELECT round_even(s_acctbal / 1000, 0) AS g, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1)
SELECT s_suppkey, s_acctbal / 1000 AS at, row_number() OVER (ORDER BY s_suppkey) - 1 AS slice FROM q JOIN supplier USING (s_suppkey)""")
def unique_geometries(spark, sf_dir):
    rows = roles.read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("at"))
    return geometry.unique_geometries(rows, ["at"], "s_suppkey", decimals=0)


@query(f"""WITH s AS (SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT region, count(*) AS slices, {r('(count(*) - 1) * 0.005e0 + 0.004e0')} AS thickness, {r('region * 0.1e0 + (count(*) - 1) * 0.0025e0')} AS cx, {r('0.25e0')} AS cy,
 {r('-0.125e0')} AS cz FROM s GROUP BY region""")
def geometry_merge(spark, sf_dir):
    """The nations of a region as its slices, in any order, merged to one volume each."""
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    rows = roles.read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), "n_nationkey", (F.row_number().over(order) - 1).alias("i"))
    slices = rows.select("region", "n_nationkey", *_constant((0.2, 0.2, 0.004), (64, 64, 1)), F.array(F.col("region") * 0.1 + F.col("i") * 0.005, F.lit(0.25), F.lit(-0.125)).alias("t_pcs"))
    out = relations.merged(slices, ["region"], "n_nationkey")
    return rounded(out.select("region", F.col("matrix")[2].cast("long").alias("slices"), F.col("fov")[2].alias("thickness"), *[F.col("t_pcs")[i].alias(f"c{c}") for i, c in enumerate("xyz")]), ["thickness", "cx", "cy", "cz"])


def _constant(fov, matrix) -> list:
    """The fields that all geometries of a query have alike."""
    return [F.lit("siemens").alias("vendor"), F.lit("HFS").alias("position"), relations.numbers(*fov).alias("fov"), F.array(*map(F.lit, matrix)).alias("matrix"), relations.rows_of(GEO.r_rps_pcs).alias("r_rps_pcs")]


@query(f"""WITH p AS (SELECT s_suppkey AS idx, s_nationkey % 5 AS g FROM supplier), f AS (SELECT g, min(idx) AS idx FROM p GROUP BY g)
SELECT row_number() OVER (ORDER BY idx) - 1 AS slice, {r('(g * 3e0 + idx * 0.00001e0) / 1000', 9)} AS x, {r('0.6e0')} AS r01, {r('-0.8e0')} AS r12 FROM f""")
def extract_geometries(spark, sf_dir):
    """Suppliers as profiles of five slices whose positions differ by less than the rounding, however large their keys are."""
    num = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    rows = roles.read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("idx"), F.array((F.col("s_nationkey") % 5) * 3.0 + F.col("s_suppkey") % 4096 * 0.00001, F.lit(0.0), F.lit(1.0)).alias("t"),
        num(0, 0, 1).alias("read"), num(0.6, 0.8, 0).alias("phase"), num(0.8, -0.6, 0).alias("slice"),
    )
    out = relations.extracted(rows, "siemens", (0.2, 0.2, 0.003), (64, 64, 1), decimals=1)
    out = out.select("slice", F.col("t_pcs")[0].alias("x"), F.col("r_rps_pcs")[0][1].alias("r01"), (-F.col("r_rps_pcs")[0][2]).alias("r12"))
    return rounded(rounded(out, ["x"], 9), ["r01", "r12"])


@query(f"""WITH g AS (SELECT s_suppkey, 0.2e0 + s_nationkey * 0.01e0 AS fx, 0.1e0 AS fy, 0.004e0 AS fz, s_acctbal / 1000 AS t FROM supplier),
c AS (SELECT s_suppkey, t, k::INT AS corner, (k // 4 - 0.5e0) * fx AS x, (k // 2 % 2 - 0.5e0) * fy AS y, (k % 2 - 0.5e0) * fz AS z FROM g, range(8) q(k))
SELECT s_suppkey, corner, {r('(z + t) * 1000', 4)} AS x, {r('(0.6e0 * x + 0.8e0 * y + 0.25e0) * 1000', 4)} AS y, {r('(-0.8e0 * x + 0.6e0 * y) * 1000', 4)} AS z FROM c""")
def fov_faces(spark, sf_dir):
    """The corners of every supplier's field of view in patient coordinates."""
    geos = roles.read(spark, sf_dir, "supplier").select(
        "s_suppkey", F.lit("siemens").alias("vendor"), F.lit("HFS").alias("position"), F.array(0.2 + F.col("s_nationkey") * 0.01, F.lit(0.1), F.lit(0.004)).alias("fov"),
        F.array(F.col("s_acctbal") / 1000, F.lit(0.25), F.lit(0.0)).alias("t_pcs"), relations.rows_of(GEO.r_rps_pcs).alias("r_rps_pcs"),
    )
    return rounded(relations.corners(geos, ["s_suppkey"]), ["x", "y", "z"], 4)


# ------------------------------------------------------------------ basis functions

_R2 = "(x*x+y*y+z*z)"
_VOX = f"({roles.VOX_SQL}) q"


def _term(n: int) -> str:
    return harmonics.TERMS[n - 1].replace("r2", _R2).replace("1.0", "1e0")


@query(f"SELECT v, {', '.join(f'{r(_term(n))} AS h{n}' for n in range(1, 17))} FROM {_VOX}")
def solid_harmonics_16(spark, sf_dir):
    vox = roles.voxels(spark, sf_dir)
    return vox.select("v", *[snapped(harmonics.term(n)).alias(f"h{n}") for n in range(1, 17)])


@query(f"SELECT v, {', '.join(f'{r(_term(n), 4)} AS h{n}' for n in range(1, 37))} FROM {_VOX}")
def solid_harmonics_36(spark, sf_dir):
    vox = roles.voxels(spark, sf_dir).withColumn("h", harmonics.terms(range(1, 37)))
    return vox.select("v", *[snapped(F.col("h")[n - 1], 4).alias(f"h{n}") for n in range(1, 37)])


@query(f"""SELECT p, {r('k0')} AS k1, {r('q1')} AS k2, {r('q2')} AS k3, {r('q3')} AS k4, {', '.join(f"{r(f'k{i}')} AS k{i + 1}" for i in range(4, 9))}
 FROM ({roles.SAMP_SQL}) q""")
def recon_terms_select(spark, sf_dir):
    rows = roles.samples(spark, sf_dir).withColumn("k", harmonics.select_orders(F.col("k"), F.col("k_dot"), 9, "101"))
    return rows.select("p", *[snapped(F.col("k")[i]).alias(f"k{i + 1}") for i in range(9)])


@query(f"""SELECT p, {', '.join(f"{r(f'q{i}' if i in (1, 2, 3) else ('0e0' if i == 0 or i > 8 else f'k{i}'))} AS k{i + 1}" for i in range(16))} FROM ({roles.SAMP_SQL}) q""")
def recon_terms_third_order(spark, sf_dir):
    """Sixteen terms, of which the second order alone is kept and the first is nominal."""
    wide = lambda c: F.concat(F.col(c), F.slice(c, 1, 7))
    rows = roles.samples(spark, sf_dir).withColumn("k", harmonics.select_orders(wide("k"), wide("k_dot"), 16, "0010"))
    return rows.select("p", *[snapped(F.col("k")[i]).alias(f"k{i + 1}") for i in range(16)])


_ORDER = "CASE WHEN t = 1 THEN 0 WHEN t <= 4 THEN 1 WHEN t <= 9 THEN 2 ELSE 3 END"


@query(f"""SELECT v, t::INT AS term, 'h' || (t - 1) AS name, o::INT AS field_order, 'T' || ['', '/m', '/m²', '/m³'][o + 1] AS unit,
 ['', 'm⁻¹', 'm⁻²', 'm⁻³'][o + 1] AS integrated_unit FROM (SELECT v, t, {_ORDER} AS o FROM (SELECT p_partkey AS v, p_size % 16 + 1 AS t FROM part) p) q""")
def term_metadata(spark, sf_dir):
    """Every part beside what is known of the term that its size stands for."""
    parts = roles.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"), (F.col("p_size") % 16 + 1).alias("term"))
    terms = F.broadcast(harmonics.term_metadata(spark).drop("expression"))  # sixteen rows
    return parts.join(terms, "term").select("v", "term", "name", "field_order", "unit", "integrated_unit")


@query(f"SELECT v, {r('z*z')} AS c1, {r('x*x+y*y')} AS c2, {r('x*z')} AS c3, {r('y*z')} AS c4 FROM {_VOX}")
def concomitant_terms(spark, sf_dir):
    vox = roles.voxels(spark, sf_dir)
    b = harmonics.with_concomitant(F.col("b"), F.col("x"), F.col("y"), F.col("z"))
    return vox.withColumn("b", b).select("v", *[snapped(F.col("b")[9 + i]).alias(f"c{i + 1}") for i in range(4)])


@query("""SELECT n, max(a)::BIGINT AS a, (n / max(a))::BIGINT AS b FROM (SELECT p_partkey + 1 AS n FROM part) q, range(1, 200) t(a)
 WHERE a * a <= n AND n % a = 0 GROUP BY n""")
def factor_pairs(spark, sf_dir):
    rows = roles.read(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("n"))
    return rows.withColumn("f", harmonics.near_square_factors(F.col("n"))).select("n", "f.a", "f.b")


@query(f"SELECT v, sqrt(re * re + im * im) > 1.2e0 AS masked FROM {_VOX}")
def threshold_mask(spark, sf_dir):
    return imaging.magnitude_mask(roles.voxels(spark, sf_dir), 1.2).select("v", "masked")


@query(f"SELECT v, v % 7 <> 0 AND sqrt(re * re + im * im) > 1.2e0 AS masked FROM {_VOX}")
def threshold_mask_nan(spark, sf_dir):
    """What is not a number is below every threshold."""
    vox = roles.voxels(spark, sf_dir).withColumn("re", F.when(F.col("v") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("re")))
    return imaging.magnitude_mask(vox, 1.2).select("v", "masked")


# ------------------------------------------------------------------ time series

_SHOT = f"({roles.SHOT_SQL}) q"
DT = 0.5


@query(f"""WITH s AS (SELECT *, lag(value) OVER (PARTITION BY u ORDER BY j) AS o FROM {_SHOT})
SELECT u, j, {r('sum(coalesce((value + o) * 0.25e0, 0)) OVER (PARTITION BY u ORDER BY j)')} AS integral FROM s""")
def cumtrapz(spark, sf_dir):
    return rounded(series.cumulative_trapezoid(roles.shots(spark, sf_dir), ["u"], DT), ["integral"]).select("u", "j", "integral")


@query(f"""SELECT u, j, {r('(n - value) / 0.5e0')} AS slope FROM (SELECT *, lead(value) OVER (PARTITION BY u ORDER BY j) AS n FROM {_SHOT}) t WHERE n IS NOT NULL""")
def finite_diff(spark, sf_dir):
    return rounded(series.forward_difference(roles.shots(spark, sf_dir), ["u"], DT), ["slope"]).select("u", "j", "slope")


def _tap(k: int) -> str:
    return f"coalesce({'lead' if k > 0 else 'lag'}(value, {abs(k)}) OVER (PARTITION BY u ORDER BY j), 0)"


@query(f"SELECT u, j, {r(f'({_tap(2)} / 8 + {_tap(1)} / 4 - {_tap(-1)} / 4 - {_tap(-2)} / 8) / 0.5e0')} AS slope FROM {_SHOT}")
def fir_derivative(spark, sf_dir):
    return rounded(series.fir_derivative(roles.shots(spark, sf_dir), ["u"], DT), ["slope"]).select("u", "j", "slope")


def _interp_sql(delay: str) -> str:
    return f"""WITH s AS ({roles.SHOT_SQL}), n AS (SELECT u, j, value AS a, lead(value) OVER (PARTITION BY u ORDER BY j) AS b FROM s),
 t AS (SELECT u, j AS i, j * 0.5e0 + {delay} AS t FROM s), w AS (SELECT u, i, floor(t / 0.5e0)::BIGINT AS j, t / 0.5e0 - floor(t / 0.5e0) AS f FROM t)
SELECT w.u, w.i, {r('coalesce(CASE WHEN b IS NOT NULL THEN a + f * (b - a) WHEN f = 0 THEN a END, 0)')} AS value
FROM w LEFT JOIN n ON n.u = w.u AND n.j = w.j"""


def _times(spark, sf_dir, delay):
    return roles.shots(spark, sf_dir).select("u", F.col("j").alias("i"), (F.col("j") * DT + delay).alias("t"))


@query(_interp_sql("0.1875e0"))
def interp_linear(spark, sf_dir):
    out = series.interpolate_linear(roles.shots(spark, sf_dir), _times(spark, sf_dir, F.lit(0.1875)), ["u"], DT)
    return rounded(out, ["value"]).select("u", "i", "value")


@query(_interp_sql("(u % 5 - 2) * 0.125e0"))
def interp_shots(spark, sf_dir):
    """One delay for each shot."""
    out = series.interpolate_linear(roles.shots(spark, sf_dir), _times(spark, sf_dir, (F.col("u") % 5 - 2) * 0.125), ["u"], DT)
    return rounded(out, ["value"]).select("u", "i", "value")


_AKIMA = f"""WITH s AS ({roles.SHOT_SQL}), d AS (SELECT *, (lead(value) OVER w - value) / 0.5e0 AS d FROM s WINDOW w AS (PARTITION BY u ORDER BY j)),
 a AS (SELECT u, j, value, lag(d, 2) OVER w AS a, lag(d) OVER w AS b, d AS c, lead(d) OVER w AS e FROM d WINDOW w AS (PARTITION BY u ORDER BY j)),
 b AS (SELECT u, j, value, a, b, coalesce(c, 2 * b - a, b) AS c, e FROM a), c AS (SELECT u, j, value, a, coalesce(b, 2 * c - e, c) AS b, c, e FROM b),
 e AS (SELECT u, j, value, coalesce(a, 2 * b - c) AS a, b, c, coalesce(e, 2 * c - b) AS e FROM c),
 l AS (SELECT u, j, value, b, c, abs(e - c) + abs(e + c) / 2 AS l, abs(b - a) + abs(b + a) / 2 AS r FROM e),
 m AS (SELECT u, j, value, CASE WHEN l + r = 0 THEN 0 ELSE (l * b + r * c) / (l + r) END AS m FROM l),
 n AS (SELECT u, j, value AS a, m, lead(value) OVER w AS b, lead(m) OVER w AS k FROM m WINDOW w AS (PARTITION BY u ORDER BY j)),
 t AS (SELECT u, j AS i, j * 0.5e0 + 0.1875e0 AS t FROM s), x AS (SELECT u, i, floor(t / 0.5e0)::BIGINT AS j, t / 0.5e0 - floor(t / 0.5e0) AS f FROM t),
 y AS (SELECT x.u, x.i, CASE WHEN b IS NOT NULL THEN (2*f*f*f - 3*f*f + 1) * a + (f*f*f - 2*f*f + f) * 0.5e0 * m + (3*f*f - 2*f*f*f) * b + (f*f*f - f*f) * 0.5e0 * k
 WHEN f = 0 THEN a END AS value FROM x LEFT JOIN n ON n.u = x.u AND n.j = x.j)
SELECT u, i, {r('coalesce(value, 0)')} AS value FROM y"""


@query(_AKIMA)
def interp_akima(spark, sf_dir):
    out = series.interpolate_akima(roles.shots(spark, sf_dir), _times(spark, sf_dir, F.lit(0.1875)), ["u"], DT)
    return rounded(out, ["value"]).select("u", "i", "value")


@query(_AKIMA.replace("SELECT u, i, (floor", "SELECT u, i AS j, (floor"))
def resample_own_times(spark, sf_dir):
    """Akima pieces at the series' own times, later by a delay."""
    return rounded(series.resampled(roles.shots(spark, sf_dir), ["u"], DT, 0.1875), ["value"])


@query(f"SELECT u, j, {r('(j + 1) * 0.5e0 * 1000')} AS ms, {r('value / 42.58e6 * 1000', 12)} AS value FROM {_SHOT}")
def display_axes(spark, sf_dir):
    """Time axes and units as plots show them."""
    out = series.gradient_units(series.with_time(roles.shots(spark, sf_dir), DT), ["value"])
    return rounded(rounded(out, ["ms"]), ["value"], 12).select("u", "j", "ms", "value")


@query(f"""WITH m AS (SELECT least(min(value), min(-2 * value)) AS a, greatest(max(value), max(-2 * value)) AS b FROM {_SHOT})
SELECT {r('a - 0.1e0 * greatest(abs(a), abs(b))')} AS low, {r('b + 0.1e0 * greatest(abs(a), abs(b))')} AS high FROM m""")
def display_limits(spark, sf_dir):
    both = roles.shots(spark, sf_dir).withColumn("other", F.col("value") * -2)
    return rounded(series.display_limits(both, ["value", "other"]), ["low", "high"])


def _response(n: int = 30, out: int = 5) -> np.ndarray:
    f = np.arange(n) - n // 2
    return np.stack([np.exp(-((f / 8.0) ** 2))[:, None] * np.exp(1j * 0.1 * f[:, None]) * (1 + 0.1 * i + 0.2 * np.arange(out)) for i in range(3)], axis=1)


def _waves(spark, sf_dir):
    s = roles.shots(spark, sf_dir)
    return s.select(F.col("u").alias("wave"), (F.col("j") % 3).cast("int").alias("i"), F.floor(F.col("j") / 3).cast("long").alias("j"), "value")


_GIRF = f"""WITH g AS (SELECT u AS wave, (j % 3)::INT AS i, j // 3 AS j, value FROM {_SHOT}), n AS (SELECT wave, max(j) AS n FROM g GROUP BY wave),
 f AS (SELECT t - 15 AS f FROM range(1, 29) q(t)),
 s AS (SELECT wave, i, f, sum(value * cos({TAU!r}e0 * f * j / 30)) AS a, -sum(value * sin({TAU!r}e0 * f * j / 30)) AS b FROM g, f GROUP BY wave, i, f),
 h AS (SELECT wave, f, o, sum(m * (a * cos(0.1e0 * f) - b * sin(0.1e0 * f))) AS a, sum(m * (a * sin(0.1e0 * f) + b * cos(0.1e0 * f))) AS b
 FROM (SELECT *, exp(-(f / 8e0) * (f / 8e0)) * (1 + 0.1e0 * i + 0.2e0 * o) AS m FROM s, range(5) r(o)) q GROUP BY wave, f, o)
SELECT h.wave, o::INT AS o, j, {{}}{r(f'sum(a * cos({TAU!r}e0 * f * j / 30) - b * sin({TAU!r}e0 * f * j / 30)) / 30')} AS value
FROM h JOIN n ON n.wave = h.wave, range(30) t(j) WHERE j <= n GROUP BY h.wave, o, j"""


@query(_GIRF.format(""))
def girf_predict(spark, sf_dir):
    return rounded(series.apply_response(_waves(spark, sf_dir), _response(), bandwidth=0.9), ["value"])


@query(_GIRF.format("CASE WHEN o = 0 THEN 'k0' WHEN o <= 3 THEN 'linear' ELSE 'higher' END AS part, "))
def girf_model(spark, sf_dir):
    """The response as a model whose output is split."""
    return rounded(series.ResponseModel(_response()).apply(_waves(spark, sf_dir), bandwidth=0.9), ["value"]).select("wave", "o", "j", "part", "value")


def _expanded_sql(n: int, size: str) -> str:
    """A response of n bins on waveforms of any length up to ``size``: its impulse response by n bins, convolved in time, as zeros in the middle of it do."""
    half = n // 2
    lag = f"CASE WHEN m < {half} THEN m ELSE m - {n} END"
    return f"""WITH g AS (SELECT u AS wave, (j % 3)::INT AS i, j // 3 AS j, value FROM {_SHOT}), n AS (SELECT wave, max(j) + 1 AS n FROM g GROUP BY wave),
 f AS (SELECT t - {half} AS f FROM range({n}) q(t)),
 h AS (SELECT i::INT AS i, o::INT AS o, {lag} AS lag, sum(exp(-(f / 8e0) * (f / 8e0)) * (1 + 0.1e0 * i + 0.2e0 * o) * cos(0.1e0 * f + {TAU!r}e0 * f * m / {n})) / {n} AS h
 FROM f, range({n}) q(m), range(3) s(i), range(5) r(o) WHERE m <> {half} GROUP BY i, o, m),
 z AS (SELECT n.wave, n, (SELECT min(s) FROM (VALUES {size}) v(s) WHERE s >= greatest(n, {n})) AS size FROM n)
SELECT z.wave, h.o, t AS j, {r('coalesce(sum(g.value * h.h), 0)')} AS value FROM z, range(200) q(t), h JOIN g ON g.i = h.i
WHERE g.wave = z.wave AND t < n AND (t - g.j - h.lag) % size = 0 GROUP BY z.wave, h.o, t"""


@query(_expanded_sql(8, ", ".join(f"({series.smooth_length(k)})" for k in sorted({series.smooth_length(x) for x in range(8, 200)}))))
def girf_expanded(spark, sf_dir):
    """A response of fewer bins than the waveforms have steps, grown to their length."""
    return rounded(series.apply_response(_waves(spark, sf_dir), _response(8)), ["value"])


@query(f"""SELECT part, count(*) AS n, {r('sum(value * (o + 1))', 3)} AS total FROM (SELECT o, value, CASE WHEN o = 0 THEN 'k0' WHEN o <= 3 THEN 'linear' ELSE 'higher' END AS part
 FROM {_SHOT}, range(5) t(o)) s GROUP BY part""")
def girf_split_channels(spark, sf_dir):
    """Every step of every series as five outputs, each in its part."""
    out = roles.shots(spark, sf_dir).select("value", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("o"))
    parts = series.split_outputs(out, 5).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * (F.col("o") + 1)).alias("total"))
    return rounded(parts, ["total"], 3)


# ------------------------------------------------------------------ channels

_CH = f"({roles.CHANNEL_SQL})"


def _cov_sql(centered: bool) -> str:
    mean = f"m AS (SELECT c, avg(re) AS mr, avg(im) AS mi FROM {_CH} q GROUP BY c)," if centered else ""
    a = ("a.re - ma.mr", "a.im - ma.mi") if centered else ("a.re", "a.im")
    b = ("b.re - mb.mr", "b.im - mb.mi") if centered else ("b.re", "b.im")
    joins = "JOIN m ma ON ma.c = a.c JOIN m mb ON mb.c = b.c" if centered else ""
    n = "(count(*) - 1)" if centered else "count(*)"
    return f"""WITH {mean} x AS {_CH}
SELECT a.c AS i, b.c AS j, {r(f'sum(({a[0]}) * ({b[0]}) + ({a[1]}) * ({b[1]})) / {n}')} AS re, {r(f'sum(({a[0]}) * ({b[1]}) - ({a[1]}) * ({b[0]})) / {n}')} AS im
FROM x a JOIN x b ON a.obs = b.obs {joins} GROUP BY 1, 2"""


@query(_cov_sql(True))
def coil_covariance(spark, sf_dir):
    return rounded(ch.covariance(roles.channels(spark, sf_dir)), ["re", "im"])


@query(_cov_sql(False))
def coil_covariance_uncentered(spark, sf_dir):
    return rounded(ch.covariance(roles.channels(spark, sf_dir), center=False), ["re", "im"])


@query(f"""SELECT obs, o::INT AS c, {r('sum(re * cos(0.1e0 * c * o) - im * sin(0.1e0 * c * o))')} AS re,
 {r('sum(re * sin(0.1e0 * c * o) + im * cos(0.1e0 * c * o))')} AS im FROM {_CH} q, range(4) t(o) GROUP BY 1, 2""")
def apply_compression(spark, sf_dir):
    matrix = np.exp(0.1j * np.outer(np.arange(32), np.arange(4)))
    table = ch.Compression(matrix, np.ones(32), 1.0).table(spark)
    return rounded(ch.apply_compression(roles.channels(spark, sf_dir), table, ["obs"]), ["re", "im"])


@query()
def fit_compression(spark, sf_dir):
    """Whitening and fit on all rows: identity error of the whitened covariance, energy kept, rank."""
    x = roles.channels(spark, sf_dir)
    noise = ch.collected(ch.covariance(x), 32)
    white = ch.whitening(noise)
    n = x.select("obs").distinct().count()
    fit = ch.fit_compression(ch.collected(ch.covariance(x, center=False), 32) * n, energy=0.9, white=white)
    error = np.abs(white.conj().T @ noise @ white - np.eye(32)).max()
    rows = [(fit.matrix.shape[1], float(fit.retained), float(error), float(fit.sigma[0] / fit.sigma[-1]))]
    return rounded(spark.createDataFrame(rows, "rank int, retained double, identity_error double, condition double"), ["retained", "identity_error", "condition"])


@query(f"""WITH x AS ({roles.SIGNAL_SQL}), e AS (SELECT sum(re * re + im * im) AS e FROM x), m AS (SELECT sum(re * re + im * im) AS e FROM ({roles.COIL_SQL}) q)
SELECT 5 AS channels, {r('e.e', 3)} AS energy, {r('m.e', 3)} AS map_energy, 1.0e0 AS retained, 1.0e0 AS scale FROM e, m""")
def compress_coils(spark, sf_dir):
    """Data and maps onto as many virtual channels as there are: a rotation, which keeps their energy."""
    data, maps, fit = ch.compress_coils(roles.signal(spark, sf_dir), roles.coils(spark, sf_dir), 5, ["p"], count=5)
    energy = lambda df, name: df.agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias(name))
    out = energy(data, "energy").crossJoin(energy(maps, "map_energy"))
    out = out.select(F.lit(fit.matrix.shape[1]).alias("channels"), "energy", "map_energy", F.lit(fit.retained).alias("retained"), F.lit(ch.inferred_scale(fit.matrix, np.eye(5))).alias("scale"))
    return rounded(rounded(out, ["energy", "map_energy"], 3), ["retained", "scale"])


@query(f"SELECT obs, {r('sqrt(sum(re * re + im * im))')} AS rss FROM {_CH} q GROUP BY obs")
def rss_combine(spark, sf_dir):
    return rounded(ch.root_sum_of_squares(roles.channels(spark, sf_dir), ["obs"]), ["rss"])


@query(f"SELECT v, {r('sum(re * re + im * im)')} AS energy FROM ({roles.COIL_SQL}) q GROUP BY v")
def coil_energy(spark, sf_dir):
    return rounded(ch.channel_energy(roles.coils(spark, sf_dir)), ["energy"])


@query(f"""WITH e AS (SELECT v, sqrt(sum(re * re + im * im)) + 1e-8 AS rss FROM ({roles.COIL_SQL}) q GROUP BY v)
SELECT q.v, c, {r('re / rss')} AS re, {r('im / rss')} AS im FROM ({roles.COIL_SQL}) q JOIN e ON e.v = q.v""")
def normalized_maps(spark, sf_dir):
    return rounded(geometry.normalize_maps(roles.coils(spark, sf_dir), ["v"]), ["re", "im"])


@query("SELECT p_partkey, ntile(7) OVER (ORDER BY p_partkey) - 1 AS part FROM part")
def balanced_ranges(spark, sf_dir):
    return ch.balanced_ranges(roles.read(spark, sf_dir, "part").select("p_partkey"), 7, "p_partkey")


# ------------------------------------------------------------------ explicit encoding

_B = [f"b{n}" for n in range(1, 10)]
_ENC = f"""vox AS (SELECT v, b0, masked, re, im, {', '.join(f'{_term(n)} AS b{n}' for n in range(1, 10))} FROM {_VOX} WHERE masked),
samp AS ({roles.SAMP_SQL}), n AS (SELECT sqrt(count(*)) AS n FROM vox), coil AS ({roles.COIL_SQL}), sig AS ({roles.SIGNAL_SQL})"""
_PHASE = f"{TAU!r}e0 * (t * b0 + " + " + ".join(f"k{i} * b{i + 1}" for i in range(9)) + ")"
_RATE = f"{TAU!r}e0 * (" + " + ".join(f"q{i} * b{i + 1}" for i in range(9)) + ")"


def _op(spark, sf_dir, multi: bool = True, **how):
    vox = roles.voxels(spark, sf_dir).where("masked")
    return encode.ExplicitOp(roles.samples(spark, sf_dir), vox.select("v", "b0", "b"), 9, roles.coils(spark, sf_dir) if multi else None, **how), vox.select("v", "re", "im")


@query(f"""WITH {_ENC}, e AS (SELECT p, re, im, cos({_PHASE}) AS c, sin({_PHASE}) AS s FROM samp, vox)
SELECT p, 0 AS c, {r('sum(re * c - im * s) / any_value(n)')} AS re, {r('sum(re * s + im * c) / any_value(n)')} AS im FROM e, n GROUP BY p""")
def forward_explicit(spark, sf_dir):
    op, image = _op(spark, sf_dir, multi=False)
    return rounded(op.forward(image), ["re", "im"])


@query(f"""WITH {_ENC}, z AS (SELECT vox.*, c, vox.re * coil.re - vox.im * coil.im AS zr, vox.re * coil.im + vox.im * coil.re AS zi FROM vox JOIN coil USING (v)),
e AS (SELECT p, c, zr, zi, cos({_PHASE}) AS co, sin({_PHASE}) AS s FROM samp, z)
SELECT p, c, {r('sum(zr * co - zi * s) / any_value(n)')} AS re, {r('sum(zr * s + zi * co) / any_value(n)')} AS im FROM e, n GROUP BY p, c""")
def forward_multicoil(spark, sf_dir):
    op, image = _op(spark, sf_dir)
    return rounded(op.forward(image), ["re", "im"])


@query(f"""WITH {_ENC}, e AS (SELECT p, re, im, cos({_PHASE}) AS c, sin({_PHASE}) AS s, {_RATE} AS d FROM samp, vox)
SELECT p, 0 AS c, {r('sum(d * (-re * s - im * c)) / any_value(n)', 4)} AS re, {r('sum(d * (re * c - im * s)) / any_value(n)', 4)} AS im FROM e, n GROUP BY p""")
def derivative_forward(spark, sf_dir):
    op, image = _op(spark, sf_dir, multi=False)
    return rounded(op.forward(image, derivative=True), ["re", "im"], 4)


_ADJ = """a AS (SELECT v, c, sum(yr * co + yi * s) AS ar, sum(yi * co - yr * s) AS ai FROM e GROUP BY v, c),
x AS (SELECT a.v, sum(ar * coil.re + ai * coil.im) / any_value(n) AS re, sum(ai * coil.re - ar * coil.im) / any_value(n) AS im FROM a JOIN coil ON coil.v = a.v AND coil.c = a.c, n GROUP BY a.v)"""


@query(f"""WITH {_ENC}, e AS (SELECT v, sig.c, sig.re AS yr, sig.im AS yi, cos({_PHASE}) AS co, sin({_PHASE}) AS s FROM samp JOIN sig USING (p), vox), {_ADJ}
SELECT p_partkey AS v, {r('coalesce(re, 0)')} AS re, {r('coalesce(im, 0)')} AS im FROM part LEFT JOIN x ON v = p_partkey""")
def adjoint_explicit(spark, sf_dir):
    op, _ = _op(spark, sf_dir)
    return rounded(op.adjoint(roles.signal(spark, sf_dir), roles.voxels(spark, sf_dir)), ["re", "im"])


@query(f"""WITH {_ENC}, z AS (SELECT vox.*, c, vox.re * coil.re - vox.im * coil.im AS zr, vox.re * coil.im + vox.im * coil.re AS zi FROM vox JOIN coil USING (v)),
f AS (SELECT p, c, zr, zi, cos({_PHASE}) AS co, sin({_PHASE}) AS s FROM samp, z),
y AS (SELECT p, c, sum(zr * co - zi * s) / any_value(n) AS yr, sum(zr * s + zi * co) / any_value(n) AS yi FROM f, n GROUP BY p, c),
e AS (SELECT v, c, yr * w AS yr, yi * w AS yi, cos({_PHASE}) AS co, sin({_PHASE}) AS s FROM samp JOIN y USING (p), vox), {_ADJ}
SELECT v, {r('re', 4)} AS re, {r('im', 4)} AS im FROM x""")
def normal_weighted(spark, sf_dir):
    op, image = _op(spark, sf_dir)
    return rounded(op.normal(image, roles.samples(spark, sf_dir).select("p", "w")), ["re", "im"], 4)


@query(ORACLES["forward_explicit"])
def forward_sql(spark, sf_dir):
    """The forward product inside whole-stage code."""
    op, image = _op(spark, sf_dir, multi=False, implementation="sql")
    return rounded(op.forward(image), ["re", "im"])


@query(ORACLES["adjoint_explicit"])
def adjoint_sql(spark, sf_dir):
    op, _ = _op(spark, sf_dir, implementation="sql")
    return rounded(op.adjoint(roles.signal(spark, sf_dir), roles.voxels(spark, sf_dir)), ["re", "im"])


@query(ORACLES["normal_weighted"])
def normal_cached(spark, sf_dir):
    """The normal product from cached phase factors."""
    op, image = _op(spark, sf_dir, blocks=(4, 4), cache=True)
    return rounded(op.normal(image, roles.samples(spark, sf_dir).select("p", "w")), ["re", "im"], 4)


@query(f"""WITH {_ENC}, e AS (SELECT p, re, im, cos({_PHASE}) AS c, sin({_PHASE}) AS s FROM samp, vox),
y AS (SELECT p, 0 AS c, sum(re * c - im * s) / any_value(n) AS re, sum(re * s + im * c) / any_value(n) AS im FROM e, n GROUP BY p)
SELECT y.p, y.c, {r('2 * y.re + y.im + 0.5e0 * sig.re')} AS re, {r('2 * y.im - y.re + 0.5e0 * sig.im')} AS im FROM y JOIN sig ON sig.p = y.p AND sig.c = y.c""")
def scaled_product(spark, sf_dir):
    """(2 - i) A x + y / 2 of one coil."""
    op, image = _op(spark, sf_dir, multi=False)
    return rounded(op.mul(image, roles.signal(spark, sf_dir).where("c = 0"), 2 - 1j, 0.5), ["re", "im"])


@query(f"""WITH s AS ({roles.SIGNAL_SQL}), b AS (SELECT p, c, re - im AS br, re + 2 * im AS bi, re, im FROM s)
SELECT {r('3e0 * sum(br * re + bi * im) / sum(br * br + bi * bi)')} AS delta FROM b""")
def delay_update_scalar(spark, sf_dir):
    s = roles.signal(spark, sf_dir)
    slope = s.select("p", "c", (F.col("re") - F.col("im")).alias("re"), (F.col("re") + 2 * F.col("im")).alias("im"))
    return rounded(encode.delay_step(s, slope, ["p", "c"], 3.0), ["delta"])


@query(f"""WITH s AS (SELECT g.p, g.c, g.re, g.im, {TAU!r}e0 * (k0 + q0) AS a FROM ({roles.SIGNAL_SQL}) g JOIN ({roles.SAMP_SQL}) k ON g.p = k.p)
SELECT p, c, {r('re * cos(-a) - im * sin(-a)')} AS re, {r('re * sin(-a) + im * cos(-a)')} AS im FROM s""")
def demodulate(spark, sf_dir):
    both = roles.signal(spark, sf_dir).join(roles.samples(spark, sf_dir).select("p", "k", "k_dot"), "p")
    return rounded(encode.demodulate(both, F.col("k_dot")[0], F.col("k")[0]), ["re", "im"]).select("p", "c", "re", "im")


# ------------------------------------------------------------------ images

_IMG = f"({roles.IMAGE_SQL})"


@query(f"SELECT n, i, j, {r('(x - min(x) OVER (PARTITION BY n)) / (max(x) OVER (PARTITION BY n) - min(x) OVER (PARTITION BY n))')} AS scaled FROM {_IMG} q")
def minmax_normalize(spark, sf_dir):
    return rounded(imaging.minmax(roles.images(spark, sf_dir), ["n"]), ["scaled"]).select("n", "i", "j", "scaled")


@query(f"SELECT n, i, j, {r('(x - avg(x) OVER (PARTITION BY n)) / stddev_pop(x) OVER (PARTITION BY n)')} AS scaled FROM {_IMG} q")
def standardize(spark, sf_dir):
    return rounded(imaging.standardize(roles.images(spark, sf_dir), ["n"]), ["scaled"]).select("n", "i", "j", "scaled")


@query(f"""WITH p AS (SELECT o_totalprice / 1000 AS rr, o_totalprice / 2000 AS ri, sum(l_extendedprice * (1 - l_discount)) / 1000 AS re, sum(l_extendedprice * l_tax) / 1000 AS im
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice),
s AS (SELECT avg((re - rr) ** 2) AS mse, sum(re * rr + im * ri) AS xr, sum(re * ri - im * rr) AS xi, sum(re * re + im * im) AS xx, sum(rr * rr + ri * ri) AS r2,
 sum((re - rr) ** 2 + (im - ri) ** 2) AS dd, sum((sqrt(re * re + im * im) - sqrt(rr * rr + ri * ri)) ** 2) AS mm FROM p)
SELECT {r('mse', 3)} AS mse, {r('xr / xx')} AS scale_re, {r('xi / xx')} AS scale_im, {r('sqrt(dd / r2)')} AS nrmse,
 {r('sqrt((r2 - (xr * xr + xi * xi) / xx) / r2)')} AS aligned_nrmse, {r('sqrt(mm / r2)')} AS magnitude_nrmse FROM s""")
def image_metrics(spark, sf_dir):
    li = roles.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000).alias("re"), (F.sum(F.col("l_extendedprice") * F.col("l_tax")) / 1000).alias("im")
    )
    o = roles.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 1000).alias("ref_re"), (F.col("o_totalprice") / 2000).alias("ref_im"))
    out = imaging.metrics(o.join(li, "l_orderkey"))
    return rounded(rounded(out, ["mse"], 3), ["scale_re", "scale_im", "nrmse", "aligned_nrmse", "magnitude_nrmse"])


_PAIRS = """SELECT o_orderkey, o_totalprice / 1000 AS rr, o_totalprice / 2000 AS ri, sum(l_extendedprice * (1 - l_discount)) / 1000 AS re, sum(l_extendedprice * l_tax) / 1000 AS im
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice"""


@query(f"""WITH p AS ({_PAIRS}), s AS (SELECT sum(re * rr + im * ri) / sum(re * re + im * im) AS a, sum(re * ri - im * rr) / sum(re * re + im * im) AS b, avg((re - rr) ** 2) AS mse,
 sqrt(sum((re - rr) ** 2 + (im - ri) ** 2) / sum(rr * rr + ri * ri)) AS nrmse FROM p),
m AS (SELECT sqrt(sum((sqrt((re * a - im * b) ** 2 + (re * b + im * a) ** 2) - sqrt(rr * rr + ri * ri)) ** 2) / sum(rr * rr + ri * ri)) AS x FROM p, s)
SELECT {r('a')} AS scale_re, {r('b')} AS scale_im, {r('mse', 3)} AS mse, {r('sqrt(mse)', 3)} AS rmse, {r('nrmse')} AS nrmse, {r('x')} AS aligned_magnitude_nrmse FROM s, m""")
def reference_metrics(spark, sf_dir):
    """Figures with the reference named first, and the error of magnitudes after alignment."""
    li = roles.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000).alias("re"), (F.sum(F.col("l_extendedprice") * F.col("l_tax")) / 1000).alias("im")
    )
    ref = roles.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), (F.col("o_totalprice") / 1000).alias("re"), (F.col("o_totalprice") / 2000).alias("im"))
    out = imaging.reference_metrics(ref, li, ["o"]).crossJoin(imaging.aligned_magnitude_nrmse(imaging.against(ref, li, ["o"])))
    return rounded(rounded(out, ["mse", "rmse"], 3), ["scale_re", "scale_im", "nrmse", "aligned_magnitude_nrmse"])


@query("SELECT p_partkey, (p_retailprice::FLOAT)::DOUBLE AS single FROM part")
def cast_precision(spark, sf_dir):
    """Prices in single precision, widened again."""
    rows = roles.read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("single"))
    return imaging.cast_precision(imaging.cast_precision(rows, "float"), "double")


@query(f"SELECT n, i - 1 AS i, j - 2 AS j, x FROM {_IMG} q WHERE i BETWEEN 1 AND 6 AND j BETWEEN 2 AND 6".replace("i - 1 AS i, j - 2 AS j", "(i - 1)::INT AS i, (j - 2)::INT AS j").replace("BETWEEN 2 AND 6", "BETWEEN 2 AND 6"))
def centre_crop(spark, sf_dir):
    return imaging.center_window(roles.images(spark, sf_dir), (8, 8), (6, 5), ["n"])


@query(f"""SELECT f.n, f.i, f.j, coalesce(q.x, 0) AS x FROM (SELECT vec_id AS n, a::INT AS i, b::INT AS j FROM embeddings, range(11) s(a), range(12) t(b)) f
LEFT JOIN {_IMG} q ON q.n = f.n AND q.i + 1 = f.i AND q.j + 2 = f.j""")
def centre_pad(spark, sf_dir):
    return imaging.center_window(roles.images(spark, sf_dir), (8, 8), (11, 12), ["n"])


@query(f"""WITH s AS (SELECT ceil(sqrt(count(*)))::BIGINT AS k FROM embeddings), t AS (SELECT (n // k) * 8 + i AS row, (n % k) * 8 + j AS col, x FROM {_IMG} q, s)
SELECT g AS row, h AS col, coalesce(x, 0) AS x FROM s, range((SELECT 8 * k FROM s)) a(g), range((SELECT 8 * k FROM s)) b(h) LEFT JOIN t ON row = g AND col = h""")
def mosaic(spark, sf_dir):
    """All images in one square of tiles."""
    img = roles.images(spark, sf_dir)
    side = math.ceil(math.sqrt(img.select("n").distinct().count()))
    return imaging.mosaic(img, (8, 8), side, side)


@query(f"SELECT n, ((j + 7) % 8)::INT AS i, (7 - i)::INT AS j, x FROM {_IMG} q")
def reorient(spark, sf_dir):
    return imaging.reorient(roles.images(spark, sf_dir), (8, 8), (0, -1))


_STENCIL = """SELECT o, (least(floor(u), 6) + k)::INT AS at, CASE WHEN k = 1 THEN u - least(floor(u), 6) ELSE 1 - (u - least(floor(u), 6)) END AS w
FROM (SELECT o, least(greatest((o + 0.5e0) * (8 / {n}e0) - 0.5e0, 0), 7) AS u FROM range({n}) t(o)) s, range(2) d(k)"""


@query(f"""WITH a AS ({_STENCIL.format(n=5)}), b AS ({_STENCIL.format(n=12)})
SELECT n, a.o::INT AS i, b.o::INT AS j, {r('sum(x * a.w * b.w)')} AS x FROM {_IMG} q JOIN a ON a.at = q.i JOIN b ON b.at = q.j GROUP BY 1, 2, 3""")
def resize_real(spark, sf_dir):
    return rounded(imaging.resize(roles.images(spark, sf_dir), (8, 8), (5, 12), ["n"]), ["x"])


@query(f"""WITH a AS ({_STENCIL.format(n=5)}), b AS ({_STENCIL.format(n=12)}), q AS (SELECT n, i, j, sqrt(x * x + (0.5e0 * x + 0.3e0) ** 2) AS m, atan2(0.5e0 * x + 0.3e0, x) AS p FROM {_IMG} q),
z AS (SELECT n, a.o::INT AS i, b.o::INT AS j, sum(m * a.w * b.w) AS m, sum(p * a.w * b.w) AS p FROM q JOIN a ON a.at = q.i JOIN b ON b.at = q.j GROUP BY 1, 2, 3)
SELECT n, i, j, {r('m * cos(p)')} AS re, {r('m * sin(p)')} AS im FROM z""")
def resize_complex(spark, sf_dir):
    img = roles.images(spark, sf_dir).select("n", "i", "j", F.col("x").alias("re"), (F.col("x") * 0.5 + 0.3).alias("im"))
    return rounded(imaging.resize_complex(img, (8, 8), (5, 12), ["n"]), ["re", "im"])


@query(f"""WITH f AS (SELECT a::INT AS a, b::INT AS b, cos({TAU!r}e0 * (a - 4) * (b - 4) / 8) / 8 AS c, -sin({TAU!r}e0 * (a - 4) * (b - 4) / 8) / 8 AS s FROM range(8) p(a), range(8) q(b)),
h AS (SELECT n, j, b AS i, sum(x * c) AS re, sum(x * s) AS im FROM {_IMG} q JOIN f ON a = i GROUP BY n, j, b)
SELECT n, i, b AS j, {r('sum(re * c - im * s)')} AS re, {r('sum(re * s + im * c)')} AS im FROM h JOIN f ON a = j GROUP BY n, i, b""")
def dft_small(spark, sf_dir):
    img = roles.images(spark, sf_dir).select("n", "i", "j", F.col("x").alias("re"), F.lit(0.0).alias("im"))
    return rounded(imaging.dft2(img, (8, 8), ["n"]), ["re", "im"])


@query(f"SELECT n, {r('quantile_cont(x, 0.01)')} AS vmin, {r('quantile_cont(x, 0.99)')} AS vmax FROM {_IMG} q GROUP BY n")
def display_window(spark, sf_dir):
    return rounded(imaging.display_window(roles.images(spark, sf_dir), ["n"]), ["vmin", "vmax"])


_SSIM = f"""WITH g AS (SELECT k, exp(-(k * k) / 4.5e0) / (SELECT sum(exp(-(k * k) / 4.5e0)) FROM range(-5, 6) t(k)) AS g FROM range(-5, 6) t(k)),
w AS (SELECT o, CASE WHEN o + k < 0 THEN -(o + k) - 1 WHEN o + k > 7 THEN 15 - (o + k) ELSE o + k END AS at, sum(g) AS w FROM range(8) t(o), g GROUP BY 1, 2),
p AS (SELECT n, i, j, abs(x) AS x, abs(x + 0.05e0 * sin(i + j)) AS y FROM {_IMG} q), m AS (SELECT n, max(y) AS m FROM p GROUP BY n),
q AS (SELECT p.n, i, j, x / m AS x, y / m AS y FROM p JOIN m ON m.n = p.n),
b AS (SELECT n, a.o AS i, b.o AS j, sum(a.w * b.w * x) AS x, sum(a.w * b.w * y) AS y, sum(a.w * b.w * x * x) AS xx, sum(a.w * b.w * y * y) AS yy, sum(a.w * b.w * x * y) AS xy
 FROM q JOIN w a ON a.at = i JOIN w b ON b.at = j GROUP BY n, a.o, b.o)
SELECT n, {r('avg((2 * x * y + 0.0001e0) * (2 * (xy - x * y) + 0.0009e0) / ((x * x + y * y + 0.0001e0) * ((xx - x * x) + (yy - y * y) + 0.0009e0)))')} AS ssim FROM b GROUP BY n"""


@query(_SSIM)
def ssim(spark, sf_dir):
    img = roles.images(spark, sf_dir)
    other = img.select("n", "i", F.col("j"), (F.col("x") + 0.05 * F.sin(F.col("i") * 1.0 + F.col("j"))).alias("ref"))
    return rounded(imaging.ssim_by_image(img.join(other, ["n", "i", "j"]), (8, 8)), ["ssim"])


# ------------------------------------------------------------------ resampling and slabs

SRC = geometry.Geometry("GE", (0.08, 0.08, 0.02), (8, 8, 1), t_pcs=(0.0, 0.0, 0.0))
TGT = geometry.Geometry("GE", (0.06, 0.05, 0.01), (12, 10, 1), t_pcs=(0.005, -0.0025, 0.002))


def _resample_sql(nearest: bool) -> str:
    u = [r(f"(((t.v % 12) - 5.5e0) * 0.005e0 + 0.005e0) / 0.01e0 + 3.5e0", 9), r(f"(((t.v // 12) - 4.5e0) * 0.005e0 - 0.0025e0) / 0.01e0 + 3.5e0", 9)]
    base = f"SELECT v, {u[0]} AS a, {u[1]} AS b FROM range(120) t(v)"
    if nearest:
        near = f"SELECT v, floor(a + 0.5e0)::INT AS i, floor(b + 0.5e0)::INT AS j, 1e0 AS w FROM ({base}) s"
    else:
        near = f"""SELECT v, (floor(a) + k)::INT AS i, (floor(b) + l)::INT AS j, (CASE WHEN k = 1 THEN a - floor(a) ELSE 1 - (a - floor(a)) END)
 * (CASE WHEN l = 1 THEN b - floor(b) ELSE 1 - (b - floor(b)) END) AS w FROM ({base}) s, range(2) d(k), range(2) e(l) WHERE a BETWEEN 0 AND 7 AND b BETWEEN 0 AND 7"""
    return f"""WITH g AS ({near}), x AS (SELECT n, v, sum(w * x) AS x FROM g JOIN {_IMG} q ON q.i = g.i AND q.j = g.j GROUP BY n, v)
SELECT 0 AS target, vec_id AS n, t.v, {r('coalesce(x, 0)')} AS x FROM embeddings CROSS JOIN range(120) t(v) LEFT JOIN x ON x.n = vec_id AND x.v = t.v"""


def _volumes(spark, sf_dir):
    return roles.images(spark, sf_dir).select("n", F.col("i").alias("ix"), F.col("j").alias("iy"), F.lit(0).alias("iz"), "x")


@query(_resample_sql(False))
def resample_trilinear(spark, sf_dir):
    return rounded(geometry.resample(_volumes(spark, sf_dir), SRC, {0: TGT}, "PCS", ["n"]), ["x"])


@query(_resample_sql(True))
def resample_nearest(spark, sf_dir):
    return rounded(geometry.resample(_volumes(spark, sf_dir), SRC, {0: TGT}, "PCS", ["n"], nearest=True), ["x"])


SRC3 = geometry.Geometry("GE", (0.08, 0.08, 0.02), (4, 4, 4))
TGT3 = {0: geometry.Geometry("GE", (0.05, 0.04, 0.009), (5, 4, 3), t_pcs=(0.0025, -0.0025, 0.001)), 7: geometry.Geometry("GE", (0.06, 0.05, 0.008), (3, 5, 2), t_pcs=(-0.0025, 0.005, -0.002))}


def _resample3_sql() -> str:
    pieces = []
    for number, geo in TGT3.items():
        (nx, ny, nz), size = geo.matrix, [f / n for f, n in zip(geo.fov, geo.matrix, strict=True)]
        index = (f"t.v % {nx}", f"t.v // {nx} % {ny}", f"t.v // {nx * ny}")
        # Two points along x at a third of the voxel, one along y, two along z.
        shift = (f"(2 * a.k - 1) * {size[0] / 6!r}e0", "0e0", f"(2 * b.k - 1) * {size[2] / 6!r}e0")
        u = []
        for axis in range(3):
            at = f"({index[axis]} - {(geo.matrix[axis] - 1) / 2!r}e0) * {size[axis]!r}e0 + {geo.t_pcs[axis]!r}e0 + {shift[axis]}"
            u.append(r(f"({at}) / {SRC3.fov[axis] / 4!r}e0 + 1.5e0", 9))
        pieces.append(f"SELECT {number} AS target, t.v, {u[0]} AS x, {u[1]} AS y, {u[2]} AS z FROM range({nx * ny * nz}) t(v), range(2) a(k), range(2) b(k)")
    weight = " * ".join(f"(CASE WHEN {k} = 1 THEN {c} - floor({c}) ELSE 1 - ({c} - floor({c})) END)" for c, k in zip("xyz", ("d.k", "e.k", "f.k"), strict=True))
    inside = " AND ".join(f"{c} BETWEEN 0 AND 3" for c in "xyz")
    return f"""WITH p AS ({' UNION ALL '.join(pieces)}), g AS (SELECT target, v, (floor(x) + d.k)::INT AS ix, (floor(y) + e.k)::INT AS iy, (floor(z) + f.k)::INT AS iz, {weight} / 4 AS w
 FROM p, range(2) d(k), range(2) e(k), range(2) f(k) WHERE {inside}),
 s AS (SELECT vec_id AS n, (a % 4)::INT AS ix, (a // 4 % 4)::INT AS iy, (a // 16)::INT AS iz, embedding[a + 1]::DOUBLE AS x FROM embeddings, range(64) q(a)),
 y AS (SELECT target, n, v, sum(w * x) AS x FROM g JOIN s ON s.ix = g.ix AND s.iy = g.iy AND s.iz = g.iz GROUP BY target, n, v), o AS (SELECT DISTINCT target, v FROM p)
SELECT o.target, vec_id AS n, o.v, {r('coalesce(x, 0)')} AS x FROM embeddings CROSS JOIN o LEFT JOIN y ON y.target = o.target AND y.n = vec_id AND y.v = o.v"""


@query(_resample3_sql())
def resample_volumes(spark, sf_dir):
    """Volumes onto two targets at once, each voxel the mean of interior points."""
    img = roles.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), F.posexplode("embedding").alias("a", "x"))
    vol = img.select("n", (F.col("a") % 4).alias("ix"), (F.floor(F.col("a") / 4) % 4).cast("int").alias("iy"), F.floor(F.col("a") / 16).cast("int").alias("iz"), F.col("x").cast("double").alias("x"))
    return rounded(geometry.resample(vol, SRC3, TGT3, "PCS", ["n"], oversample=(2, 1, 2)), ["x"])


@query(f"SELECT v, ix::INT AS ix, iy::INT AS iy, iz::INT AS iz FROM ({_PART_GRID}) q WHERE ix % 3 = 0 AND iy % 2 = 0 AND iz % 5 = 0")
def grid_decimated(spark, sf_dir):
    shape, parts = _part_grid(spark, sf_dir)
    return geometry.decimated(geometry.Grid(shape, GRID.spacing).table(spark).join(parts, "v"), (3, 2, 5)).select("v", "ix", "iy", "iz")


@query(f"""SELECT n_regionkey AS slab, 18 AS slices, {r('18 * 0.002e0')} AS thickness, {r('n_regionkey * 0.1e0 + 0.012e0')} AS cx FROM nation GROUP BY n_regionkey""")
def merged_slabs_geometry(spark, sf_dir):
    """Three slabs of eight slices for each region, merged to eighteen slices."""
    regions = roles.read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("slab")).distinct()
    slabs = regions.select("slab", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    slabs = slabs.select("slab", "i", *_constant((0.2, 0.2, 0.016), (64, 64, 8)), F.array(F.col("slab") * 0.1 + 0.012 * F.col("i"), F.lit(0.0), F.lit(0.0)).alias("t_pcs"))
    out = relations.merged_slabs(slabs, ["slab"], "i", 18)
    return rounded(out.select("slab", F.col("matrix")[2].alias("slices"), F.col("fov")[2].alias("thickness"), F.col("t_pcs")[0].alias("cx")), ["thickness", "cx"])


def _slabs(spark, sf_dir):
    """Runs of five embeddings as slabs of eight slices (j) with eight pixels (i)."""
    img = roles.images(spark, sf_dir)
    return img.select(F.floor(F.col("n") / 5).alias("stack"), (F.col("n") % 5).alias("slab"), F.col("i"), F.col("j").alias("z"), "x")


_SLAB = f"SELECT n // 5 AS stack, n % 5 AS slab, i, j AS z, (n % 5) * 6 + j AS zz, x FROM {_IMG} q"


@query(f"SELECT stack, i, zz AS z, x FROM ({_SLAB}) s WHERE NOT (slab > 0 AND z < 1) AND NOT (slab < 4 AND z >= 7)")
def merge_slabs(spark, sf_dir):
    return geometry.merge_slabs(_slabs(spark, sf_dir), 8, 2, "discard")


@query(f"SELECT stack, i, zz AS z, arg_max(x, (abs(x), -slab)) AS x FROM ({_SLAB}) s GROUP BY stack, i, zz")
def motsa_mip(spark, sf_dir):
    return geometry.merge_slabs(_slabs(spark, sf_dir), 8, 2, "mip")


@query(f"""SELECT stack, i, zz AS z, {r('sum(x * CASE WHEN slab > 0 AND z < 2 THEN z / 1e0 WHEN slab < 4 AND z >= 6 THEN (7 - z) / 1e0 ELSE 1e0 END)')} AS x
 FROM ({_SLAB}) s GROUP BY stack, i, zz""")
def motsa_blend(spark, sf_dir):
    return rounded(geometry.merge_slabs(_slabs(spark, sf_dir), 8, 2, "blend"), ["x"])


# ------------------------------------------------------------------ low-rank products

#: The voxels' grid; several voxels may share a cell.
CELLS, SPACING = (20, 20, 3), (0.125, 0.125, 0.25)


def _voxel_cells(spark, sf_dir) -> DataFrame:
    vox = roles.voxels(spark, sf_dir).where("masked")
    place = {"ix": F.col("v") % 20, "iy": F.floor(F.col("v") / 20) % 20, "iz": F.round(F.col("z") / SPACING[2]) + 1}
    return vox.withColumns({n: c.cast("int") for n, c in place.items()})


def _lowrank(spark, sf_dir, options: lowrank.Options | None = None, multi: bool = True, **how):
    vox, samples = _voxel_cells(spark, sf_dir), roles.samples(spark, sf_dir)
    if options is None:
        # As many ranks as doubles can tell apart: nothing is left out.
        options = lowrank.full_options(vox, samples, 9, False, method="per_readout")
    csm = roles.coils(spark, sf_dir) if multi else None
    return lowrank.LowRankOp(samples, vox, CELLS, SPACING, csm=csm, options=options, **how), vox.select("v", "re", "im")


@query(ORACLES["forward_multicoil"])
def lowrank_forward(spark, sf_dir):
    """All ranks of all readouts: the explicit signal."""
    op, image = _lowrank(spark, sf_dir)
    return rounded(op.forward(image), ["re", "im"])


@query(ORACLES["forward_explicit"])
def lowrank_forward_exact(spark, sf_dir):
    """One coil, one basis for all readouts at full rank, separable transforms."""
    options = lowrank.full_options(_voxel_cells(spark, sf_dir), roles.samples(spark, sf_dir), 9, False, tol=1e-12, most=1000)
    op, image = _lowrank(spark, sf_dir, options, multi=False, kernel="separable")
    return rounded(op.forward(image), ["re", "im"])


@query(ORACLES["adjoint_explicit"])
def lowrank_adjoint(spark, sf_dir):
    op, _ = _lowrank(spark, sf_dir, coils=2, kernel="gridding")
    return rounded(op.adjoint(roles.signal(spark, sf_dir), roles.voxels(spark, sf_dir)), ["re", "im"])


@query(ORACLES["normal_weighted"])
def lowrank_normal(spark, sf_dir):
    """The signal is summed over all ranks before it is weighted."""
    op, image = _lowrank(spark, sf_dir)
    return rounded(op.normal(image, roles.samples(spark, sf_dir).select("p", "w")), ["re", "im"], 4)


@query(ORACLES["normal_weighted"])
def lowrank_normal_by_readout(spark, sf_dir):
    """Each coil and readout from image to image in one task, by a normal operator."""
    op, image = _lowrank(spark, sf_dir)
    normal = op.normal_operator(roles.samples(spark, sf_dir).select("p", "w"), by="readout")
    return rounded(normal.forward(image), ["re", "im"], 4)


@query(ORACLES["normal_weighted"])
def lowrank_normal_tables(spark, sf_dir):
    """Factors at full rank whose both sides are tables: no sample passes through the driver."""
    vox, samples = _voxel_cells(spark, sf_dir), roles.samples(spark, sf_dir)
    op = lowrank.LowRankOp(samples, vox, CELLS, SPACING, csm=roles.coils(spark, sf_dir), tables=lambda g, f: tallfactors.rsvd(g, f, None))
    return rounded(op.normal(vox.select("v", "re", "im"), samples.select("p", "w")), ["re", "im"], 4)


# ------------------------------------------------------------------ factors (figures only)


def _features(spark, sf_dir):
    """Spatial features (v, g, n) of the classes of equal masked voxels, and temporal ones of all samples by readout."""
    g = factors.distinct_voxels(lowrank.voxel_features(roles.voxels(spark, sf_dir).where("masked"), 9, False))
    return g, factors.rows_by_readout(lowrank.readout_features(roles.samples(spark, sf_dir), 9, False))[2]


def _figures(spark, **values) -> DataFrame:
    return rounded(spark.createDataFrame([tuple(float(x) for x in values.values())], ", ".join(f"{k} double" for k in values)), list(values))


def _sides(spark, sf_dir):
    """Spatial features (v, g, n), temporal ones (p, f, n), as classes of equal ones, both sides' members (v, rep) and (p, rep), and the image (v, re, im)."""
    vox = roles.voxels(spark, sf_dir).where("masked")
    g, voxels = tallfactors.classes(lowrank.voxel_features(vox, 9, False), "v", "g")
    f, samples = tallfactors.classes(lowrank.temporal_features(roles.samples(spark, sf_dir), 9, False), "p", "f")
    return factors.spread(g, True), f, voxels, samples, vox.select("v", "re", "im")


@query()
def rsvd_factor_error(spark, sf_dir):
    """The error of randomised factors, both sides of which are tables, and of those of one readout finished by triangles."""
    g, samples, _, members, _ = _sides(spark, sf_dir)
    rank = min(30, members.count() - 5)
    q, basis = tallfactors.rsvd(g, samples, rank)
    readouts = factors.rows_by_readout(lowrank.readout_features(roles.samples(spark, sf_dir), 9, False))[2]
    q2, basis2 = factors.rsvd(g, readouts[0], min(rank, len(readouts[0])), 0, finalize="svd")
    return _figures(spark, rank=rank, error=tallfactors.relative_error(g, samples, q, basis), first_readout=factors.relative_error(g, basis2, readouts[0], q2))


_RESIDUAL = f"""WITH {_ENC}, e AS (SELECT p, re, im, cos(a) AS c, sin(a) AS s FROM (SELECT p, vox.re, vox.im, {TAU!r}e0 * (t * b0 + {' + '.join(f'k{i} * b{i + 1}' for i in range(4, 9))}) AS a FROM samp, vox) q)
SELECT p, {r('sum(re * c - im * s)', 4)} AS re, {r('sum(re * s + im * c)', 4)} AS im FROM e GROUP BY p"""


@query(_RESIDUAL)
def rsvd_full_rank(spark, sf_dir):
    """Randomised factors of as many ranks as doubles can tell apart, times the image: what all residual phases make of it."""
    g, samples, voxels, members, image = _sides(spark, sf_dir)
    q, basis = tallfactors.rsvd(g, samples, None)
    return rounded(_product(q, basis, image, voxels, members), ["re", "im"], 4)


def _product(q: DataFrame, basis: DataFrame, image: DataFrame, voxels: DataFrame, samples: DataFrame) -> DataFrame:
    """(p, re, im) of q S^H x, of classes of equal voxels and samples, whose members (v, rep) and (p, rep) are given."""
    sums = image.join(voxels, "v").groupBy(F.col("rep").alias("v")).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return tallfactors.times_image(q, basis, sums).withColumnRenamed("p", "rep").join(samples, "rep").select("p", "re", "im")


@query(_RESIDUAL.replace("1e4", "1e1"))
def recompressed_full_rank(spark, sf_dir):
    """Factors recompressed in a metric of times and voxels to all their ranks: another basis, the same product."""
    g, _, voxels, _, image = _sides(spark, sf_dir)
    features = lowrank.readout_features(roles.samples(spark, sf_dir), 9, False)
    _, reps, readouts = factors.rows_by_readout(features)
    rows = factors.Rows.joined(readouts)
    rank = min(factors.full_rank(g, rows), len(rows.f))
    q, basis = factors.rsvd(g, rows, rank, 0)
    # The weight of a class is the mean of its voxels'.
    weights = image.join(voxels, "v").groupBy(F.col("rep").alias("v")).agg(F.avg(1 + F.abs("re")).alias("w"))
    weighted = basis.join(weights, "v")
    gram = factors.gram(basis, "s", "s", rank, rank)
    # Ranks that hold nothing are left out first, as the metric must tell directions apart.
    keep = int((np.linalg.eigvalsh(gram) > 1e-11 * np.linalg.norm(gram, 2)).sum())
    basis = factors.mapped(weighted, lambda part: factors.unpack(part["s"])[:, :keep], keep=("v", "n", "w"))
    q, basis, _ = factors.recompress(q[:, :keep], basis, rank=keep, time_weight=1.0 + np.arange(len(rows)) % 3, weight="w", rows=rows)
    p = np.concatenate(reps)
    own = features.groupBy("d", "f").agg(F.min("p").alias("rep"))
    members = features.join(own, ["d", "f"]).select("p", "rep")
    return rounded(_product(lowrank._temporal(spark, p, np.zeros(len(p)), q).select("p", "q"), basis, image, voxels, members), ["re", "im"], 1)


@query("""SELECT d, 0e0 AS error FROM (SELECT DISTINCT s_suppkey % 8 AS d FROM supplier) q""")
def per_readout_full_rank(spark, sf_dir):
    """Factors of every readout at its full rank: the error of each, which is none."""
    vox, samples = roles.voxels(spark, sf_dir).where("masked"), roles.samples(spark, sf_dir)
    g = factors.distinct_voxels(lowrank.voxel_features(vox, 9, False))
    names, _, readouts = factors.rows_by_readout(lowrank.readout_features(samples, 9, False))
    options = lowrank.full_options(vox, samples, 9, False)
    q, basis = factors.per_readout(g, readouts, options.rank, 0)
    return rounded(spark.createDataFrame(_errors(g, basis, readouts, q, names), "d long, error double"), ["error"])


def _errors(g: DataFrame, basis: DataFrame, readouts: list, q: np.ndarray, names: list) -> list[tuple]:
    """The error of every readout's own factors."""
    edges = np.cumsum([0, *[len(x.f) for x in readouts]])
    return [(names[d], float(factors.relative_error(g, basis.where(F.col("d") == d).drop("d"), x, q[edges[d] : edges[d + 1]]))) for d, x in enumerate(readouts)]


def _ranks(readouts, most: int) -> tuple[int, int]:
    """Rank and oversampling that the shortest readout allows."""
    width = min(len(f) for f in readouts)
    over = min(5, max(width - 1, 0))
    return max(min(most, width - over), 1), over


@query()
def incremental_shared_error(spark, sf_dir):
    g, readouts = _features(spark, sf_dir)
    rank, over = _ranks(readouts, 15)
    us, coeff, basis = factors.shared_factors(g, readouts, rank, oversample=over)
    q = factors.assemble(us, coeff)
    last = factors.relative_error(g, factors.readout_factor(basis, coeff[-1]), readouts[-1], us[-1])
    return _figures(spark, rank=q.shape[1], error=factors.relative_error(g, basis, factors.Rows.joined(readouts), q), last=last, orthogonality=factors.orthogonality(basis, q.shape[1]))


@query()
def per_readout_error(spark, sf_dir):
    """Factors of every readout, half of them kept: the error of each."""
    g, readouts = _features(spark, sf_dir)
    rank, over = _ranks(readouts, 8)
    q, basis = factors.per_readout(g, readouts, rank, over, keep_bytes=16 * rank * g.count() * len(readouts) // 2)
    return rounded(spark.createDataFrame(_errors(g, basis, readouts, q, list(range(len(readouts)))), "d int, error double"), ["error"])


@query()
def sampled_shared_report(spark, sf_dir):
    """A basis from half of the readouts, fitted on sampled voxels and checked on others."""
    g, readouts = _features(spark, sf_dir)
    rank, over = _ranks(readouts, 15)
    q, basis, report = factors.sampled_shared(g, readouts, rank, max(len(readouts) // 2, 1), oversample=over)
    error = factors.relative_error(g, basis, factors.Rows.joined(readouts), q)
    return _figures(spark, rank=report["rank"], checked=report["phase_check"]["error"], error=error, held_out=report["phase_check"]["held_out"])


@query()
def snapshot_basis_error(spark, sf_dir):
    """Bases of a fixed rank in both orders, from snapshots, fitted on a pool of voxels."""
    g, readouts = _features(spark, sf_dir)
    f = factors.Rows.joined(readouts)
    rank = min(24, -(-len(f) // 3))
    found = {}
    for ordering in ("snapshot", "coefficients"):
        q, basis, _ = factors.fixed_basis(g, readouts, rank, min(32, len(f)), ordering, every=2)
        found[ordering] = factors.relative_error(g, basis, f, q)
    return _figures(spark, rank=rank, **found)


@query()
def joint_basis_report(spark, sf_dir):
    g, readouts = _features(spark, sf_dir)
    q, basis, report = factors.joint_basis(g, readouts, tol=0.1, every=2)
    error = factors.relative_error(g, basis, factors.Rows.joined(readouts), q) if report["passed"] else float("nan")
    return _figures(spark, rank=report["rank"], snapshots=report["snapshots"], validation=report["validation"], audit=report.get("audit", float("nan")), error=error, passed=report["passed"])


@query()
def adaptive_basis_report(spark, sf_dir):
    g, readouts = _features(spark, sf_dir)
    _, _, trials = factors.adaptive_factors(g, readouts, 0.1, parent=16, every=2)
    rows = [(x["snapshots"], x["samples"], x["parent"], x["width"], x["bound"], x["rank"], x.get("cause")) for x in trials]
    return rounded(spark.createDataFrame(rows, "snapshots int, samples int, parent int, width int, bound double, rank int, cause string"), ["bound"])


@query()
def paired_prefix_error(spark, sf_dir):
    """Mean loss and standard error of every prefix of the ranks on uniform pairs of rows and voxels."""
    g, readouts = _features(spark, sf_dir)
    f = factors.Rows.joined(readouts)
    q, basis = factors.rsvd(g, f, min(20, len(f) - 5))
    rows = factors.paired_errors(f, q, g, basis, 1234, factors.ACCEPTANCE_PAIRS)
    return rounded(spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in rows], "rank int, loss double, error double"), ["loss", "error"])


@query()
def recompress_error(spark, sf_dir):
    g, readouts = _features(spark, sf_dir)
    f = factors.Rows.joined(readouts)
    q, basis = factors.rsvd(g, f, min(30, len(f) - 5))
    q2, basis2, tail = factors.recompress(q, basis, tol=0.05, rows=f)
    both = factors.beside(basis2, basis.withColumnRenamed("s", "o"))
    many = f.weight

    def loss(pdf):
        old, new = factors.unpack(pdf["o"]).conj().T, factors.unpack(pdf["s"]).conj().T
        n = factors.copies(pdf)[:, 0]
        return np.array([[many @ np.abs(q @ old - q2 @ new) ** 2 @ n], [many @ np.abs(q @ old) ** 2 @ n]])

    a, b = factors.summed(both, loss, (2, 1)).real.ravel()
    return _figures(spark, rank=q2.shape[1], predicted=tail, measured=math.sqrt(a / b))


@query()
def lowrank_forward_vs_explicit(spark, sf_dir):
    """A recompressed, coil-weighted shared basis against the explicit product."""
    longest = roles.samples(spark, sf_dir).groupBy("d").count().agg(F.max("count")).first()[0]
    rank = max(min(15, longest - 2), 1)
    options = lowrank.Options(rank=rank, oversample=min(2, longest - rank), tol=1e-4, recompress_tol=1e-3, coil_weighting=True)
    op, image = _lowrank(spark, sf_dir, options, coils=5)
    explicit, _ = _op(spark, sf_dir)
    both = op.forward(image).join(explicit.forward(image).withColumnsRenamed({"re": "er", "im": "ei"}), ["p", "c"])
    gap = both.agg(F.sqrt(F.sum((F.col("re") - F.col("er")) ** 2 + (F.col("im") - F.col("ei")) ** 2) / F.sum(F.col("er") ** 2 + F.col("ei") ** 2)).alias("error"))
    return rounded(gap.withColumn("rank", F.lit(op.rank)), ["error"])


# ------------------------------------------------------------------ files


@query(f"SELECT p_partkey AS v, (p_partkey % 20)::INT AS ix, (p_partkey // 20 % 20)::INT AS iy, (p_partkey // 400)::INT AS iz, {r('CAST(p_retailprice / 1000e0 AS FLOAT)::DOUBLE')} AS value FROM part")
def volume_roundtrip(spark, sf_dir):
    """All voxels written as a volume by ranges, members of one file, and read back by members."""
    vox = roles.voxels(spark, sf_dir).select(F.col("v").alias("cell"), F.col("re").alias("value"))
    depth = -(-(vox.agg(F.max("cell").alias("m")).first()["m"] + 1) // 400)
    path = f"{shared.shared_dir(spark)}/fieldweave/volume-{uuid.uuid4().hex}.nii.gz"
    volumes.write_volume(vox, path, (20, 20, depth), np.eye(3, 4))
    got = volumes.read_volume(spark, path).withColumnRenamed("cell", "v")
    return rounded(got.join(vox.select(F.col("cell").alias("v")), "v", "left_semi"), ["value"])


# ------------------------------------------------------------------ solvers

_NORMAL = """f{i} AS MATERIALIZED (SELECT p, c, sum(zr * co - zi * s) / any_value(n) AS yr, sum(zr * s + zi * co) / any_value(n) AS yi FROM (SELECT ph.p, coil.c, co, s,
 x.re * coil.re - x.im * coil.im AS zr, x.re * coil.im + x.im * coil.re AS zi FROM ph JOIN p{i} x ON x.v = ph.v JOIN coil ON coil.v = ph.v) q, n GROUP BY p, c),
a{i} AS MATERIALIZED (SELECT v, sum(ar * cr + ai * ci) / any_value(n) AS re, sum(ai * cr - ar * ci) / any_value(n) AS im FROM (SELECT ph.v, f.c, sum(yr * co + yi * s) AS ar,
 sum(yi * co - yr * s) AS ai, any_value(coil.re) AS cr, any_value(coil.im) AS ci FROM ph JOIN f{i} f ON f.p = ph.p JOIN coil ON coil.v = ph.v AND coil.c = f.c GROUP BY ph.v, f.c) q, n GROUP BY v)"""


def _gradients_sql(steps: int, l2: str) -> str:
    """Conjugate gradients on the normal equations, one set of tables for each step."""
    out = [f"{_ENC}", f"ph AS MATERIALIZED (SELECT p, v, cos({_PHASE}) AS co, sin({_PHASE}) AS s FROM samp, vox)",
           """r0 AS MATERIALIZED (SELECT v, sum(ar * cr + ai * ci) / any_value(n) AS re, sum(ai * cr - ar * ci) / any_value(n) AS im FROM (SELECT ph.v, f.c, sum(f.re * co + f.im * s) AS ar,
 sum(f.im * co - f.re * s) AS ai, any_value(coil.re) AS cr, any_value(coil.im) AS ci FROM ph JOIN sig f ON f.p = ph.p JOIN coil ON coil.v = ph.v AND coil.c = f.c GROUP BY ph.v, f.c) q, n GROUP BY v)""",
           "p0 AS MATERIALIZED (SELECT * FROM r0)", "x0 AS MATERIALIZED (SELECT v, 0e0 AS re, 0e0 AS im FROM r0)"]
    for i in range(steps):
        out.append(_NORMAL.format(i=i))
        out.append(f"h{i} AS MATERIALIZED (SELECT a.v, a.re + {l2} * p.re AS re, a.im + {l2} * p.im AS im FROM a{i} a JOIN p{i} p ON p.v = a.v)")
        out.append(f"g{i} AS MATERIALIZED (SELECT (SELECT sum(re * re + im * im) FROM r{i}) / (SELECT sum(p.re * h.re + p.im * h.im) FROM p{i} p JOIN h{i} h ON h.v = p.v) AS g)")
        out.append(f"x{i + 1} AS MATERIALIZED (SELECT x.v, x.re + g * p.re AS re, x.im + g * p.im AS im FROM x{i} x JOIN p{i} p ON p.v = x.v, g{i})")
        out.append(f"r{i + 1} AS MATERIALIZED (SELECT r.v, r.re - g * h.re AS re, r.im - g * h.im AS im FROM r{i} r JOIN h{i} h ON h.v = r.v, g{i})")
        out.append(f"b{i} AS MATERIALIZED (SELECT (SELECT sum(re * re + im * im) FROM r{i + 1}) / (SELECT sum(re * re + im * im) FROM r{i}) AS b)")
        out.append(f"p{i + 1} AS MATERIALIZED (SELECT r.v, r.re + b * p.re AS re, r.im + b * p.im AS im FROM r{i + 1} r JOIN p{i} p ON p.v = r.v, b{i})")
    return f"WITH {', '.join(out)} SELECT v, {r('re', 5)} AS re, {r('im', 5)} AS im FROM x{steps}"


@query(_gradients_sql(3, "0.01e0"))
def recon_cgnr(spark, sf_dir):
    """The image after three steps of conjugate gradients."""
    op, _ = _op(spark, sf_dir)
    return rounded(solve.reconstruct(op, roles.signal(spark, sf_dir), iterations=3, l2=1e-2), ["re", "im"], 5)


def _density_sql(steps: int) -> str:
    """The kernel of all pairs of samples, and the weights after each step."""
    axis = lambda d: f"(SELECT sum(cos({TAU!r}e0 * d{d} * x)) FROM range(-10, 10) t(x))"
    # A sum over -10..9 is a cosine sum and one lone term.
    parts = [f"k AS (SELECT p, k1 / (2 * m) AS a, k2 / (2 * m) AS b FROM ({roles.SAMP_SQL}) q, (SELECT max(greatest(abs(k1), abs(k2))) AS m FROM ({roles.SAMP_SQL}) q) t)",
             "d AS (SELECT p.p, q.p AS q, p.a - q.a AS d1, p.b - q.b AS d2 FROM k p, k q)",
             f"e AS MATERIALIZED (SELECT p, q, {axis(1)} AS c1, -sin({TAU!r}e0 * d1 * 10) AS s1, {axis(2)} AS c2, -sin({TAU!r}e0 * d2 * 10) AS s2 FROM d)",
             "g AS MATERIALIZED (SELECT p, q, c1 * c2 - s1 * s2 AS a, c1 * s2 + s1 * c2 AS b FROM e)", "w0 AS (SELECT p, 1e0 AS w FROM k)"]
    for i in range(steps):
        parts.append(f"t{i} AS MATERIALIZED (SELECT g.p, sqrt(sum(a * w) ** 2 + sum(b * w) ** 2) AS s FROM g JOIN w{i} w ON w.p = g.q GROUP BY g.p)")
        parts.append(f"w{i + 1} AS MATERIALIZED (SELECT w.p, w / s AS w FROM w{i} w JOIN t{i} t ON t.p = w.p)")
    return f"WITH {', '.join(parts)} SELECT p, {r(f'sqrt(w) / sqrt((SELECT avg(w) FROM w{steps}))', 5)} AS w FROM w{steps}"


@query(_density_sql(10))
def density_weights(spark, sf_dir):
    nodes = roles.samples(spark, sf_dir).select("p", F.slice("k", 2, 2).alias("node"))
    return rounded(solve.density_weights(nodes, (20, 20), normalize=True), ["w"], 5)


# Clock offsets: the events of a user are the gradient of a readout, the nations are points.
_POINTS = [("v", "CAST(n_nationkey AS BIGINT)"), ("x", f"({roles.D('n_nationkey % 5')} - 2E0) * 0.4E0"), ("y", f"({roles.D('floor(n_nationkey / 5E0)')} - 2E0) * 0.4E0"), ("z", "0E0"),
           ("b0", f"({roles.D('n_nationkey % 7')} - 3E0) * 4E0"), ("re", f"1E0 + 0.1E0 * {roles.D('n_nationkey % 3')}"), ("im", f"0.05E0 * {roles.D('n_nationkey')} - 0.6E0")]
_DT, _TRUTH, _ROUNDS, _STEPS, _JUMP = 1e-5, 2.5, 3, 3, 2.0


def _start(many: bool) -> str:
    """The offset of each readout's own clock."""
    return f"({roles.D('u % 5')} - 2E0) * 1E-6" if many else "0E0"


def _rounds_sql(many: bool) -> str:
    """The rounds of the search: interpolation, conjugate gradients, residual and step, one set of tables each."""
    at = lambda n: "".join([f"coalesce(lead(k{n}, 2) OVER w, 0e0) / 8 + coalesce(lead(k{n}) OVER w, 0e0) / 4", f" - coalesce(lag(k{n}) OVER w, 0e0) / 4 - coalesce(lag(k{n}, 2) OVER w, 0e0) / 8"])
    value = lambda n: f"coalesce(CASE WHEN {n}_b IS NOT NULL THEN {n}_a + f * ({n}_b - {n}_a) WHEN f = 0 THEN {n}_a END, 0e0) AS {n}"
    names = ("k1", "k2", "q1", "q2")
    out = [f"vox AS ({roles.sql(_POINTS, 'nation')}), ev AS ({roles.SHOT_SQL})",
           "g AS (SELECT u, j, coalesce((lag(value - 50e0) OVER w + value - 50e0) * 0.5e0, 0e0) AS d FROM ev WINDOW w AS (PARTITION BY u ORDER BY j))",
           "kk AS (SELECT u, j, 0.004e0 * sum(d) OVER (PARTITION BY u ORDER BY j) AS k1, 2e0 * cos((j + 3e0 * u) / 7e0) AS k2 FROM g)",
           f"kq AS (SELECT u, j, k1, k2, ({at(1)}) / {_DT} AS q1, ({at(2)}) / {_DT} AS q2 FROM kk WINDOW w AS (PARTITION BY u ORDER BY j))",
           f"node AS MATERIALIZED (SELECT u, j, {', '.join(f'{n} AS {n}_a, lead({n}) OVER w AS {n}_b' for n in names)} FROM kq WINDOW w AS (PARTITION BY u ORDER BY j))",
           f"samp AS MATERIALIZED (SELECT u, u * 1000000 + j AS p, (j + 0.25e0) * {_DT} AS t, {_start(many)} AS start FROM ev)"]

    def phases(name: str, tau: str, source: str) -> list[str]:
        return [f"i{name} AS (SELECT p, u, t, (t + start + {tau} * 1e-6) / {_DT} AS w FROM samp{source})",
                f"k{name} AS MATERIALIZED (SELECT p, t, {', '.join(map(value, names))} FROM (SELECT p, t, w - floor(w) AS f, node.* FROM i{name} i LEFT JOIN node ON node.u = i.u AND node.j = floor(i.w)) s)",
                f"ph{name} AS MATERIALIZED (SELECT p, v, cos(a) AS co, sin(a) AS s, rate FROM (SELECT p, v, {TAU!r}e0 * (t * b0 + k1 * x + k2 * y) AS a, {TAU!r}e0 * (q1 * x + q2 * y) AS rate FROM k{name}, vox) e)"]

    there = lambda ph, x: f"SELECT p, 0.2e0 * sum(x.re * co - x.im * s) AS re, 0.2e0 * sum(x.re * s + x.im * co) AS im FROM {ph} JOIN {x} x USING (v) GROUP BY p"
    back = lambda ph, y: f"SELECT v, 0.2e0 * sum(y.re * co + y.im * s) AS re, 0.2e0 * sum(y.im * co - y.re * s) AS im FROM {ph} JOIN {y} y USING (p) GROUP BY v"
    out += phases("t", f"{_TRUTH}e0", "") + [f"data AS MATERIALIZED ({there('pht', 'vox')})", f"t0 AS (SELECT 0e0 AS tau, {_JUMP}e0 AS jump, NULL::DOUBLE AS moved)"]
    for i in range(_ROUNDS):
        ph = f"ph{i}"
        out += phases(str(i), "tau", f", t{i}")
        out += [f"r{i}_0 AS MATERIALIZED ({back(ph, 'data')})", f"p{i}_0 AS (SELECT * FROM r{i}_0)", f"x{i}_0 AS (SELECT v, 0e0 AS re, 0e0 AS im FROM vox)"]
        for n in range(_STEPS):
            a, b = f"{i}_{n}", f"{i}_{n + 1}"
            out += [f"f{a} AS MATERIALIZED ({there(ph, 'p' + a)})", f"h{a} AS MATERIALIZED ({back(ph, 'f' + a)})",
                    f"g{a} AS MATERIALIZED (SELECT (SELECT sum(re * re + im * im) FROM r{a}) / (SELECT sum(p.re * h.re + p.im * h.im) FROM p{a} p JOIN h{a} h USING (v)) AS g)",
                    f"x{b} AS MATERIALIZED (SELECT x.v, x.re + g * p.re AS re, x.im + g * p.im AS im FROM x{a} x JOIN p{a} p USING (v), g{a})",
                    f"r{b} AS MATERIALIZED (SELECT r.v, r.re - g * h.re AS re, r.im - g * h.im AS im FROM r{a} r JOIN h{a} h USING (v), g{a})",
                    f"b{a} AS MATERIALIZED (SELECT (SELECT sum(re * re + im * im) FROM r{b}) / (SELECT sum(re * re + im * im) FROM r{a}) AS b)",
                    f"p{b} AS MATERIALIZED (SELECT r.v, r.re + b * p.re AS re, r.im + b * p.im AS im FROM r{b} r JOIN p{a} p USING (v), b{a})"]
        x = f"x{i}_{_STEPS}"
        out += [f"m{i} AS ({there(ph, x)})",
                f"d{i} AS (SELECT p, 0.2e0 * sum(rate * (-x.re * s - x.im * co)) AS re, 0.2e0 * sum(rate * (x.re * co - x.im * s)) AS im FROM {ph} JOIN {x} x USING (v) GROUP BY p)",
                f"""s{i} AS MATERIALIZED (SELECT any_value(jump) / 1e-6 * sum(d.re * (y.re - m.re) + d.im * (y.im - m.im)) / sum(d.re * d.re + d.im * d.im) AS step
 FROM data y JOIN m{i} m USING (p) JOIN d{i} d USING (p), t{i})""",
                f"t{i + 1} AS MATERIALIZED (SELECT tau + step AS tau, CASE WHEN sign(step) <> sign(moved) THEN greatest(1e0, jump / 2) ELSE jump END AS jump, step AS moved FROM t{i}, s{i})"]
    rows = " UNION ALL ".join(f"SELECT {i + 1} AS round, {r('moved', 4)} AS step, {r('tau', 4)} AS delay, jump FROM t{i + 1}" for i in range(_ROUNDS))
    return f"WITH {', '.join(out)} {rows}"


def _delays(spark, sf_dir, many: bool) -> DataFrame:
    points = roles.view(roles.read(spark, sf_dir, "nation"), _POINTS).withColumn("b", harmonics.terms(range(1, 10)))
    shots = roles.shots(spark, sf_dir).withColumn("value", F.col("value") - 50.0)
    stored = shared.Stored(series.cumulative_trapezoid(shots, ["u"], 1.0).select("u", "j", "integral"))
    walk = stored.read()
    curve = [0.004 * F.col("integral"), 2.0 * F.cos((F.col("j") + 3.0 * F.col("u")) / 7.0)]
    field = walk.select(F.col("u").alias("shot"), "j", F.array(F.lit(0.0), *curve, *[F.lit(0.0)] * 6).alias("value"))
    times = walk.select(F.col("u").alias("shot"), (F.col("u") * 1000000 + F.col("j")).alias("p"), ((F.col("j") + 0.25) * _DT).alias("t"), F.expr(_start(many)).alias("start"))
    # The data are what the operator makes of the points where the field clock is _TRUTH late.
    at = times.withColumns({"t0": F.col("t"), "t": F.col("t") + F.col("start") + _TRUTH * 1e-6})
    k = series.interpolate_arrays(series.with_next(field, ["shot"]), at, ["shot"], _DT, 9).select("p", F.col("t0").alias("t"), F.col("value").alias("k"))
    data = encode.NearOp(k, points.select("v", "b0", "b"), 9, keep=False).forward(points.select("v", "re", "im"))
    rounds = solve.delay_rounds(points.select("v", "b0", "b"), data, field, times, _DT, 9, jump=_JUMP, iterations=_STEPS)
    rows = [(i + 1, *map(float, row)) for i, row in enumerate(itertools.islice(rounds, _ROUNDS))]
    rounds.close()
    stored.drop()
    return rounded(spark.createDataFrame(rows, "round int, step double, delay double, jump double"), ["step", "delay"], 4)


@query(_rounds_sql(False))
def find_delay(spark, sf_dir):
    """The first rounds of the search for the offset of a clock that all readouts share."""
    return _delays(spark, sf_dir, False)


@query(_rounds_sql(True))
def find_delay_shots(spark, sf_dir):
    """The same where the readouts' own clocks start apart."""
    return _delays(spark, sf_dir, True)
