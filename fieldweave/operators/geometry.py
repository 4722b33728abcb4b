"""Grids, scanner coordinates, resampling between geometries and slab merging.

Geometries are few (slices or slabs), so they are frozen dataclasses on the driver; everything of
the size of a volume is a table.
"""

from __future__ import annotations

import itertools
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Patient to device rotations by position, and nominal to logical axes by vendor.
PATIENT_TO_DEVICE = {
    "HFS": ((1, 0, 0), (0, -1, 0), (0, 0, -1)),
    "HFP": ((-1, 0, 0), (0, 1, 0), (0, 0, -1)),
    "HFDR": ((0, 1, 0), (1, 0, 0), (0, 0, -1)),
    "HFDL": ((0, -1, 0), (-1, 0, 0), (0, 0, -1)),
    "FFS": ((-1, 0, 0), (0, -1, 0), (0, 0, 1)),
    "FFP": ((1, 0, 0), (0, 1, 0), (0, 0, 1)),
    "FFDR": ((0, -1, 0), (1, 0, 0), (0, 0, 1)),
    "FFDL": ((0, 1, 0), (-1, 0, 0), (0, 0, 1)),
}
#: Sign of programmed against logical gradients, the same on all three axes.
NOMINAL_SIGN = {"SIEMENS": -1, "GE": 1, "PHILIPS": 1, "UIH": 1}


@dataclass(frozen=True)
class Grid:
    """A centred Cartesian grid, x fastest; spacing in metres."""

    shape: tuple[int, int, int]
    spacing: tuple[float, float, float]
    exchange_xy: bool = False
    reverse: tuple[bool, bool, bool] = (False, False, False)

    def table(self, spark: SparkSession) -> DataFrame:
        """(v, ix, iy, iz, x, y, z); ``exchange_xy`` swaps the coordinates, ``reverse`` runs one backwards over the whole volume."""
        nx, ny, nz = self.shape
        n = nx * ny * nz

        def index(v: Column, axis: int) -> Column:
            return (v % nx, F.floor(v / nx) % ny, F.floor(v / (nx * ny)))[axis].cast("int")

        def place(axis: int) -> Column:
            source = {0: 1, 1: 0}.get(axis, axis) if self.exchange_xy else axis
            v = F.lit(n - 1) - F.col("v") if self.reverse[axis] else F.col("v")
            return (index(v, source) - (self.shape[source] - 1) / 2) * self.spacing[source]

        v = spark.range(n).withColumnRenamed("id", "v")
        return v.select("v", *[index(F.col("v"), a).alias(c) for a, c in enumerate(("ix", "iy", "iz"))], *[place(a).alias(c) for a, c in enumerate("xyz")])

    def to_dict(self) -> dict:
        return asdict(self) | {"version": 1}

    @staticmethod
    def from_dict(d: dict) -> Grid:
        return Grid(tuple(d["shape"]), tuple(d["spacing"]), d.get("exchange_xy", False), tuple(d.get("reverse", (False,) * 3)))


@dataclass(frozen=True)
class Geometry:
    """Where a slice or slab lies: logical (RPS) to patient (PCS) to device (DCS) coordinates."""

    vendor: str
    fov: tuple[float, float, float]
    matrix: tuple[int, int, int]
    position: str = "HFS"
    t_pcs: tuple[float, float, float] = (0.0, 0.0, 0.0)
    r_rps_pcs: tuple = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    dimension: int = 3
    slice: int = 0
    r_rps_dcs: tuple = field(init=False)
    t_dcs: tuple = field(init=False)

    def __post_init__(self):
        vendor = self.vendor.upper()
        if vendor not in NOMINAL_SIGN or self.position not in PATIENT_TO_DEVICE or (vendor != "SIEMENS" and self.position != "HFS"):
            raise ValueError(f"no rotation for {self.vendor} {self.position}")
        r = np.array(PATIENT_TO_DEVICE[self.position], float)
        object.__setattr__(self, "vendor", vendor)
        object.__setattr__(self, "r_rps_dcs", _rows(r @ np.array(self.r_rps_pcs)))
        object.__setattr__(self, "t_dcs", tuple(float(x) for x in r @ np.array(self.t_pcs)))

    def frame(self, space: str) -> tuple[np.ndarray, np.ndarray]:
        """Rotation and offset from logical coordinates to ``space`` (PCS or DCS)."""
        if space == "PCS":
            return np.array(self.r_rps_pcs, float), np.array(self.t_pcs, float)
        if space == "DCS":
            return np.array(self.r_rps_dcs, float), np.array(self.t_dcs, float)
        raise ValueError(f"no space {space}")

    def to_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k not in ("r_rps_dcs", "t_dcs")}

    @staticmethod
    def from_dict(d: dict) -> Geometry:
        tup = lambda v: tuple(map(tup, v)) if isinstance(v, (list, tuple)) else v
        return Geometry(**{k: tup(v) for k, v in d.items() if k not in ("r_rps_dcs", "t_dcs")})


def _rows(m: np.ndarray) -> tuple:
    return tuple(tuple(float(x) for x in row) for row in m)


def rps_grid(spark: SparkSession, geo: Geometry) -> DataFrame:
    return Grid(geo.matrix, tuple(f / n for f, n in zip(geo.fov, geo.matrix, strict=True))).table(spark)


def linear(m: np.ndarray, names=("x", "y", "z")) -> list[Column]:
    """The rows of m times columns ``names``; zero entries are left out."""
    out = []
    for row in np.asarray(m, float):
        total = None
        for a, c in zip(row, names, strict=True):
            if a:
                total = F.col(c) * float(a) if total is None else total + F.col(c) * float(a)
        out.append(F.lit(0.0) if total is None else total)
    return out


def to_space(df: DataFrame, geo: Geometry, space: str) -> DataFrame:
    """Logical coordinates x, y, z to PCS or DCS."""
    r, t = geo.frame(space)
    return df.withColumns({c: e + float(o) for c, e, o in zip("xyz", linear(r), t, strict=True)})


def from_space(df: DataFrame, geo: Geometry, space: str) -> DataFrame:
    """PCS or DCS coordinates back to logical ones."""
    r, t = geo.frame(space)
    moved = df.withColumns({c: F.col(c) - float(o) for c, o in zip("xyz", t, strict=True)})
    return moved.withColumns(dict(zip("xyz", linear(r.T), strict=True)))


def rotate_gradients(df: DataFrame, geo: Geometry, names=("gx", "gy", "gz"), polarity=None, back: bool = False) -> DataFrame:
    """Nominal gradients to device axes (or back); the polarity is the vendor's unless given."""
    sign = np.eye(3) * NOMINAL_SIGN[geo.vendor] if polarity is None else np.array(polarity, float)
    m = np.array(geo.r_rps_dcs) @ sign
    return df.withColumns(dict(zip(names, linear(m.T if back else m, names), strict=True)))


def fov_faces(grid: Grid, r: np.ndarray | None = None) -> np.ndarray:
    """The eight corners of the field of view in mm, half a voxel beyond the outer centres."""
    half = np.array(grid.shape) * np.array(grid.spacing) / 2 * 1e3
    corners = np.array(list(itertools.product((-1, 1), repeat=3))) * half
    return corners if r is None else corners @ np.asarray(r).T


def unique_geometries(profiles: DataFrame, keys: list[str], order: str, decimals: int = 4) -> DataFrame:
    """The first profile of each geometry (``keys`` rounded half to even), numbered by first occurrence."""
    rounded = [F.bround(F.col(k), decimals).alias(f"_{k}") for k in keys]
    first = profiles.groupBy(*rounded).agg(F.min_by(F.struct(order, *keys), order).alias("p")).select("p.*")
    # One row for each geometry: slices, not profiles.
    return first.withColumn("slice", (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))


def merge_geometries(geos: list[Geometry]) -> Geometry:
    """One volume of aligned slices: sorted along the first normal, thickness added to their span."""
    first = geos[0]
    if any(g.r_rps_pcs != first.r_rps_pcs or g.fov != first.fov for g in geos):
        raise ValueError("slices must be aligned and of one size")
    normal = np.array(first.r_rps_pcs)[:, 2]
    centres = sorted((tuple(g.t_pcs) for g in geos), key=lambda t: float(np.dot(t, normal)))
    at = [float(np.dot(t, normal)) for t in centres]
    if len(at) > 2 and not np.allclose(np.diff(at), np.diff(at)[0], rtol=1e-3, atol=1e-6):
        raise ValueError("slices must be evenly spaced")
    middle = (np.array(centres[0]) + np.array(centres[-1])) / 2
    return Geometry(first.vendor, (*first.fov[:2], at[-1] - at[0] + first.fov[2]), (*first.matrix[:2], len(geos)), first.position,
                    tuple(map(float, middle)), first.r_rps_pcs)


def extract_geometries(profiles: DataFrame, vendor: str, fov: tuple[float, float, float], matrix: tuple[int, int, int], position: str = "HFS", decimals: int = 4) -> list[Geometry]:
    """The geometries of acquired profiles (idx, t array, read array, phase array, slice array) by first occurrence.

    Positions and directions come in millimetres and unit vectors; profiles equal after rounding are
    one geometry, which keeps the values of its first profile.
    """
    flat = [(n, i) for n in ("t", "read", "phase", "slice") for i in range(3)]
    rows = profiles.select("idx", *[F.get(n, F.lit(i)).cast("double").alias(f"{n}{i}") for n, i in flat])
    found = unique_geometries(rows, [f"{n}{i}" for n, i in flat], "idx", decimals).orderBy("slice").collect()
    vector = lambda r, n: [r[f"{n}{i}"] for i in range(3)]
    turn = lambda r: _rows(np.array([vector(r, n) for n in ("read", "phase", "slice")]).T)
    return [Geometry(vendor, fov, matrix, position, tuple(x * 1e-3 for x in vector(r, "t")), turn(r)) for r in found]


def merged_slabs_geometry(geos: list[Geometry], slices: int) -> Geometry:
    """The geometry of slabs merged to ``slices``: from the outer face of the first slab to that of the last one."""
    first, last = geos[0], geos[-1]
    normal = np.array(first.r_rps_pcs)[:, 2]
    ends = np.array(first.t_pcs) - normal * first.fov[2] / 2, np.array(last.t_pcs) + normal * last.fov[2] / 2
    fov = (*first.fov[:2], slices * first.fov[2] / first.matrix[2])
    return Geometry(first.vendor, fov, (*first.matrix[:2], slices), first.position, tuple(map(float, (ends[0] + ends[1]) / 2)), first.r_rps_pcs)


def decimated(grid: DataFrame, step: tuple[int, int, int]) -> DataFrame:
    """Every step-th point (ix, iy, iz) of a grid, for display."""
    if min(step) < 1:
        raise ValueError("steps start from 1")
    return grid.where(" AND ".join(f"{c} % {s} = 0" for c, s in zip(("ix", "iy", "iz"), step, strict=True)))


def affine(geo: Geometry) -> np.ndarray:
    """3 x 4 voxel to world matrix in mm, patient axes turned from LPS to RAS."""
    step = np.array(geo.fov) / np.array(geo.matrix)
    r = np.array(geo.r_rps_pcs)
    origin = np.array(geo.t_pcs) - r @ (step * (np.array(geo.matrix) - 1) / 2)
    out = np.concatenate([r * step, origin[:, None]], axis=1) * 1e3
    out[:2] *= -1
    return out.astype(np.float32)


def resample(source: DataFrame, src: Geometry, targets: dict[int, Geometry], space: str = "DCS", keys: list[str] | None = None,
             nearest: bool = False, oversample: tuple[int, int, int] = (1, 1, 1), value: str = "x") -> DataFrame:
    """Volumes (keys.., ix, iy, iz, value) on the grids of ``targets``: (target, keys.., v, value).

    Each target point is mapped to source indices and meets its eight corners (its nearest voxel) by
    an equi-join; outside the source the value is 0.  ``oversample`` averages that many interior
    points along each axis of a target voxel.  A source axis of one voxel extends as far as it is
    thick.  All targets are one job.
    """
    spark, keys = source.sparkSession, keys or []
    if nearest:
        oversample = (1, 1, 1)
    step = np.array(src.fov) / np.array(src.matrix)
    parts = []
    for number, geo in targets.items():
        size = np.array(geo.fov) / np.array(geo.matrix)
        shifts = [np.linspace(-s / 2, s / 2, n + 2)[1:-1] for s, n in zip(size, oversample, strict=True)]
        points = F.array(*[F.struct(*[F.lit(float(d)).alias(c) for c, d in zip("abc", p, strict=True)]) for p in itertools.product(*shifts)])
        grid = rps_grid(spark, geo).withColumn("_o", F.explode(points))
        grid = grid.withColumns({c: F.col(c) + F.col(f"_o.{o}") for c, o in zip("xyz", "abc", strict=True)})
        parts.append(from_space(to_space(grid, geo, space), src, space).select(F.lit(number).alias("target"), "v", "x", "y", "z"))
    points = parts[0]
    for more in parts[1:]:
        points = points.unionByName(more)
    share = 1.0 / int(np.prod(oversample))
    for axis, c, n in zip(("ix", "iy", "iz"), "xyz", src.matrix, strict=True):
        u = F.col(c) / float(step["xyz".index(c)]) + (n - 1) / 2
        points = points.withColumn(f"_{axis}", F.floor(u * 1e9 + 0.5) / 1e9)
        u = F.col(f"_{axis}")
        if nearest:
            near = F.array(F.struct(F.floor(u + 0.5).cast("int").alias("at"), F.lit(1.0).alias("w")))
        elif n == 1:
            near = F.array(F.struct(F.lit(0).alias("at"), F.when(F.abs(u) <= 0.5, 1.0).otherwise(0.0).alias("w")))
        else:
            inside = (u >= 0) & (u <= n - 1)
            low = F.floor(u)
            near = F.array(*[F.struct((low + k).cast("int").alias("at"), F.when(inside, (u - low) if k else 1 - (u - low)).otherwise(0.0).alias("w")) for k in (0, 1)])
        points = points.withColumn(f"_{axis}s", near)
    for axis in ("ix", "iy", "iz"):
        points = points.withColumn(f"_{axis}n", F.explode(f"_{axis}s"))
    stencil = points.select(
        "target", "v", *[F.col(f"_{a}n.at").alias(a) for a in ("ix", "iy", "iz")], (F.col("_ixn.w") * F.col("_iyn.w") * F.col("_izn.w") * share).alias("_w")
    ).where("_w > 0")
    stencil = stencil.groupBy("target", "v", "ix", "iy", "iz").agg(F.sum("_w").alias("_w"))
    src_rows = source.select(*keys, *[F.col(a).cast("int").alias(a) for a in ("ix", "iy", "iz")], value)
    summed = stencil.join(src_rows, ["ix", "iy", "iz"]).groupBy("target", *keys, "v").agg(F.sum(F.col("_w") * F.col(value)).alias(value))
    frame = points.select("target", "v").distinct()
    if keys:
        # Every volume gets the whole frame; neither side is of a known size.
        frame = src_rows.select(*keys).distinct().crossJoin(frame)
    return frame.join(summed, ["target", *keys, "v"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def normalize_maps(df: DataFrame, keys: list[str], eps: float = 1e-8) -> DataFrame:
    """Coil maps (keys.., c, re, im) over their root sum of squares; what is not a number becomes 0."""
    rss = F.sqrt(F.sum(F.col("re") ** 2 + F.col("im") ** 2).over(Window.partitionBy(*keys))) + eps
    fix = lambda c: F.when(F.isnan(c), 0.0).otherwise(c)
    return df.withColumn("_rss", rss).withColumns({"re": fix(F.col("re") / F.col("_rss")), "im": fix(F.col("im") / F.col("_rss"))}).drop("_rss")


def merge_slabs(df: DataFrame, n_z: int, overlap: int, method: str = "discard", value: str = "x") -> DataFrame:
    """Slabs (slab from 0 in order, z, pixel keys.., value) along z to one volume.

    discard: half the overlap goes on each inner side.  mip: where slabs overlap the larger
    magnitude stays, ties the earlier slab.  blend: the overlap cross-fades linearly.
    """
    if method not in ("discard", "mip", "blend") or not 0 <= overlap <= n_z // 2 or overlap % 2:
        raise ValueError("no such method, or the overlap is odd or exceeds half a slab")
    pixel = [c for c in df.columns if c not in ("slab", "z", value)]
    last = df.agg(F.max("slab").alias("m")).first()["m"] or 0
    stride = n_z - overlap
    out = df.withColumn("_z", F.col("slab") * stride + F.col("z"))
    if method == "discard":
        half = overlap // 2
        inner_low, inner_high = (F.col("slab") > 0), (F.col("slab") < last)
        kept = out.where(~(inner_low & (F.col("z") < overlap - half)) & ~(inner_high & (F.col("z") >= n_z - half)))
        return kept.select(*pixel, F.col("_z").cast("long").alias("z"), value)
    keys = [*pixel, F.col("_z").cast("long").alias("z")]
    if method == "mip":
        return out.groupBy(*keys).agg(F.max_by(value, F.struct(F.abs(value), -F.col("slab"))).alias(value))
    up = F.col("z") / max(overlap - 1, 1)
    down = (n_z - 1 - F.col("z")) / max(overlap - 1, 1)
    w = F.when((F.col("slab") > 0) & (F.col("z") < overlap), up).when((F.col("slab") < last) & (F.col("z") >= n_z - overlap), down).otherwise(1.0)
    return out.groupBy(*keys).agg(F.sum(w * F.col(value)).alias(value))
