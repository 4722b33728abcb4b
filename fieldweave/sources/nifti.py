"""NIfTI-1 files from volumes: a 348-byte header, little-endian samples, gzip."""

from __future__ import annotations

import gzip
import struct

import numpy as np
from pyspark.sql import DataFrame

from ..operators.geometry import Geometry, affine


def volume(df: DataFrame, shape: tuple[int, int, int], value: str = "x") -> np.ndarray:
    """A volume (v, value) as an array on the driver; one image, of a size that a file holds."""
    out = np.zeros(int(np.prod(shape)), np.float32)
    rows = df.select("v", value).toPandas()
    out[rows["v"].to_numpy()] = rows[value].to_numpy()
    return out.reshape(shape, order="F")


def write(x: np.ndarray, geo: Geometry, path: str) -> np.ndarray:
    """Writes a real 3-D or 4-D image to path (.nii.gz); returns its 3 x 4 affine in mm."""
    if x.ndim not in (3, 4) or np.iscomplexobj(x) or x.shape[:3] != geo.matrix:
        raise ValueError("a real 3-D or 4-D image of the geometry's size is needed")
    return _save(x, affine(geo), path)


def _save(x: np.ndarray, m: np.ndarray, path: str) -> np.ndarray:
    head = bytearray(348)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, x.ndim, *x.shape, *[1] * (7 - x.ndim))
    struct.pack_into("<hh", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *[float(np.linalg.norm(m[:, i])) for i in range(3)], *[1.0] * 4)
    struct.pack_into("<fff", head, 108, 352.0, 1.0, 0.0)
    head[123] = 2
    struct.pack_into("<hh", head, 252, 0, 1)
    for i in range(3):
        struct.pack_into("<4f", head, 280 + 16 * i, *map(float, m[i]))
    head[344:348] = b"n+1\0"
    with gzip.open(path, "wb") as f:
        f.write(bytes(head) + b"\0" * 4 + np.asarray(x, "<f4").tobytes(order="F"))
    return m


def write_complex(x: np.ndarray, geo: Geometry, stem: str) -> np.ndarray:
    """Magnitude and phase to stem_mag.nii.gz and stem_pha.nii.gz."""
    write(np.abs(x), geo, f"{stem}_mag.nii.gz")
    return write(np.angle(x), geo, f"{stem}_pha.nii.gz")


def stack_affine(geos: list[Geometry]) -> np.ndarray:
    """The affine of a stack of slices in order: anchored at the first one, spaced as the first two centres."""
    m = affine(geos[0]).astype(float)
    if len(geos) > 1:
        spacing = np.linalg.norm(np.subtract(geos[1].t_pcs, geos[0].t_pcs)) * 1e3
        corner = m[:, 2] * ((geos[0].matrix[2] - 1) / 2)
        unit = m[:, 2] / np.linalg.norm(m[:, 2])
        m[:, 3] += corner - unit * spacing * ((geos[0].matrix[2] - 1) / 2)
        m[:, 2] = unit * spacing
    return m.astype(np.float32)


def write_stack(x: np.ndarray, geos: list[Geometry], order: list[int], path: str) -> np.ndarray:
    """Writes slices (third axis of a 3-D or 4-D image, one for each geometry) in the order of their numbers."""
    if x.ndim not in (3, 4) or np.iscomplexobj(x) or x.shape[2] != len(geos) or len(order) != len(geos):
        raise ValueError("a real 3-D or 4-D image with one slice for each geometry is needed")
    at = np.argsort(order, kind="stable")
    return _save(x[:, :, at], stack_affine([geos[i] for i in at]), path)


def write_complex_stack(x: np.ndarray, geos: list[Geometry], order: list[int], stem: str) -> np.ndarray:
    """Magnitude and phase of a complex stack to stem_mag.nii.gz and stem_pha.nii.gz."""
    write_stack(np.abs(x), geos, order, f"{stem}_mag.nii.gz")
    return write_stack(np.angle(x), geos, order, f"{stem}_pha.nii.gz")


def read(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Image and affine of a file that ``write`` made."""
    with gzip.open(path) as f:
        raw = f.read()
    dims = struct.unpack_from("<8h", raw, 40)
    shape = dims[1 : 1 + dims[0]]
    m = np.array([struct.unpack_from("<4f", raw, 280 + 16 * i) for i in range(3)], np.float32)
    return np.frombuffer(raw, "<f4", offset=352).reshape(shape, order="F"), m
