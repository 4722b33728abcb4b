"""Geometries as a table: any number of slices or slabs in one job.

A geometry is a row (vendor, position, fov, matrix, t_pcs, r_rps_pcs) beside whatever names it; fov, matrix and
t_pcs are arrays of three numbers, r_rps_pcs an array of three rows.  Rotations, offsets and signs are
columns, points and gradients meet them by a join, and merging is an aggregate over the slices of a volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import NOMINAL_SIGN, PATIENT_TO_DEVICE, unique_geometries

FIELDS = ["vendor", "position", "fov", "matrix", "t_pcs", "r_rps_pcs"]


def numbers(*x: float) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


def rows_of(m) -> Column:
    """A constant matrix as an array of rows."""
    return F.array(*[numbers(*row) for row in m])


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def column(m: Column, j: int) -> Column:
    return F.transform(m, lambda row: row[j])


def times(m: Column, v: Column) -> Column:
    """The matrix m times the vector v."""
    return F.transform(m, lambda row: dot(row, v))


def with_frames(geos: DataFrame) -> DataFrame:
    """Adds t_dcs, r_rps_dcs and sign (of programmed against logical gradients); fails for unknown vendors and positions."""
    known = lambda table, of: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), of(v))])
    vendor = F.upper("vendor")
    turn, sign = known(PATIENT_TO_DEVICE, rows_of)[F.col("position")], known(NOMINAL_SIGN, lambda s: F.lit(float(s)))[vendor]
    fits = turn.isNotNull() & sign.isNotNull() & ((vendor == "SIEMENS") | (F.col("position") == "HFS"))
    why = F.concat(F.lit("no rotation for "), F.coalesce("vendor", F.lit("null")), F.lit(" "), F.coalesce("position", F.lit("null")))
    geos = geos.withColumns({"vendor": F.when(fits, vendor).otherwise(F.raise_error(why)), "_turn": turn, "sign": sign})
    both = F.transform("_turn", lambda row: F.array(*[dot(row, column(F.col("r_rps_pcs"), j)) for j in range(3)]))
    return geos.withColumns({"t_dcs": times(F.col("_turn"), F.col("t_pcs")), "r_rps_dcs": both}).drop("_turn")


def _joined(rows: DataFrame, geos: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    return rows.join(with_frames(geos).select(*by, *[F.col(f).alias(f"_{f}") for f in fields]), by)


def placed(points: DataFrame, geos: DataFrame, by: list[str], space: str = "DCS", back: bool = False) -> DataFrame:
    """Points (by, x, y, z) from logical coordinates to ``space`` (PCS or DCS) of their geometry, or back."""
    if space not in ("PCS", "DCS"):
        raise ValueError(f"no space {space}")
    r, t = f"r_rps_{space.lower()}", f"t_{space.lower()}"
    rows = _joined(points, geos, by, [r, t])
    turn, offset, at = F.col(f"_{r}"), F.col(f"_{t}"), F.array("x", "y", "z")
    if back:
        moved = F.zip_with(at, offset, lambda a, b: a - b)
        new = {c: dot(column(turn, i), moved) for i, c in enumerate("xyz")}
    else:
        new = {c: dot(turn[i], at) + offset[i] for i, c in enumerate("xyz")}
    return rows.select(*[c for c in points.columns if c not in "xyz"], *[e.alias(c) for c, e in new.items()])


def rotated(gradients: DataFrame, geos: DataFrame, by: list[str], names: tuple[str, str, str] = ("gx", "gy", "gz"), back: bool = False) -> DataFrame:
    """Nominal gradients (by, names) to device axes of their geometry, or back."""
    rows, g = _joined(gradients, geos, by, ["r_rps_dcs", "sign"]), F.array(*names)
    turn = F.col("_r_rps_dcs")
    new = {c: F.col("_sign") * (dot(column(turn, i), g) if back else dot(turn[i], g)) for i, c in enumerate(names)}
    return rows.select(*[c for c in gradients.columns if c not in names], *[e.alias(c) for c, e in new.items()])


def extracted(profiles: DataFrame, vendor: str, fov: tuple[float, float, float], matrix: tuple[int, int, int], position: str = "HFS", decimals: int = 4) -> DataFrame:
    """The geometries (slice, ...) of acquired profiles (idx, t, read, phase, slice arrays) by first occurrence.

    Positions and directions come in millimetres and unit vectors; profiles equal after rounding are
    one geometry, which keeps the values of its first profile.
    """
    flat = [(n, i) for n in ("t", "read", "phase", "slice") for i in range(3)]
    rows = profiles.select("idx", *[F.get(n, F.lit(i)).cast("double").alias(f"{n}{i}") for n, i in flat])
    found = unique_geometries(rows, [f"{n}{i}" for n, i in flat], "idx", decimals)
    turn = F.array(*[F.array(*[F.col(f"{n}{i}") for n in ("read", "phase", "slice")]) for i in range(3)])
    return found.select(
        "slice", F.lit(vendor).alias("vendor"), F.lit(position).alias("position"), numbers(*fov).alias("fov"), F.array(*[F.lit(n) for n in matrix]).alias("matrix"),
        F.array(*[F.col(f"t{i}") * 1e-3 for i in range(3)]).alias("t_pcs"), turn.alias("r_rps_pcs"),
    )


def merged(slices: DataFrame, by: list[str], order: str) -> DataFrame:
    """One volume of the aligned slices of each group: sorted along the normal, thickness added to their span.

    Fails where slices are turned against each other, differ in size or are not evenly spaced.
    """
    at = dot(F.col("t_pcs"), column(F.col("r_rps_pcs"), 2))
    first = [F.min_by(c, order).alias(c) for c in ("vendor", "position", "fov", "matrix", "r_rps_pcs")]
    rows = slices.groupBy(*by).agg(
        *first, F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("t_pcs").alias("t")))).alias("s"),  # the slices of one volume
        F.count_distinct("r_rps_pcs", "fov").alias("kinds"),
    )
    n = F.size("s")
    gaps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get("s", i)["at"] - F.get("s", i - 1)["at"])
    even = (n <= 2) | F.forall(gaps, lambda g: F.abs(g - F.get(gaps, F.lit(0))) <= 1e-6 + 1e-3 * F.abs(F.get(gaps, F.lit(0))))
    low, high = F.get("s", F.lit(0)), F.get("s", n - 1)
    thick = F.when(F.col("kinds") != 1, F.raise_error(F.lit("slices must be aligned and of one size"))).when(~even, F.raise_error(F.lit("slices must be evenly spaced")))
    return rows.select(
        *by, "vendor", "position",
        F.array(F.col("fov")[0], F.col("fov")[1], thick.otherwise(high["at"] - low["at"] + F.col("fov")[2])).alias("fov"),
        F.array(F.col("matrix")[0], F.col("matrix")[1], n).alias("matrix"),
        F.zip_with(low["t"], high["t"], lambda a, b: (a + b) / 2).alias("t_pcs"), "r_rps_pcs",
    )


def merged_slabs(slabs: DataFrame, by: list[str], order: str, slices: int) -> DataFrame:
    """The geometry of each group's slabs merged to ``slices``: from the outer face of the first slab to that of the last one."""
    ends = [f(F.struct(*FIELDS), order).alias(n) for f, n in ((F.min_by, "a"), (F.max_by, "b"))]
    rows = slabs.groupBy(*by).agg(*ends)
    normal = column(F.col("a.r_rps_pcs"), 2)
    face = lambda g, sign: F.zip_with(F.col(f"{g}.t_pcs"), normal, lambda t, n: t + sign * n * F.col(f"{g}.fov")[2] / 2)
    return rows.select(
        *by, "a.vendor", "a.position",
        F.array(F.col("a.fov")[0], F.col("a.fov")[1], slices * F.col("a.fov")[2] / F.col("a.matrix")[2]).alias("fov"),
        F.array(F.col("a.matrix")[0], F.col("a.matrix")[1], F.lit(slices)).alias("matrix"),
        F.zip_with(face("a", -1.0), face("b", 1.0), lambda a, b: (a + b) / 2).alias("t_pcs"), "a.r_rps_pcs",
    )


def corners(geos: DataFrame, by: list[str], space: str = "PCS") -> DataFrame:
    """(by, corner, x, y, z): the eight corners of every field of view in mm, ``corner`` 0 to 7 with the last axis fastest."""
    sign = lambda place: (F.floor(F.col("corner") / place) % 2) - 0.5
    logical = geos.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
    logical = logical.select(*by, "corner", *[(sign(p) * F.col("fov")[i]).alias(c) for i, (c, p) in enumerate((("x", 4), ("y", 2), ("z", 1)))])
    return placed(logical, geos, by, space).withColumns({c: F.col(c) * 1e3 for c in "xyz"})
