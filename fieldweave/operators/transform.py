"""Transforms between a Cartesian grid and arbitrary nodes where no task holds the grid.

forward: f[p] = sum_j x[j] exp(2 pi i node_p . (j - shape // 2)), nodes in cycles per cell; adjoint: its adjoint.

The finer grid of the gridding method is cut along its first axis into slabs.  Samples go to the slab
they lie in, in parts of a bounded number, and are spread there into the slab with a halo of half a
window on either side; planes that several slabs reach are added up.  Planes are transformed within
themselves, then cut into pencils that run along the first axis (a transpose, by one shuffle), which are
transformed along it.  forward goes the same way back: pencils, planes, slabs with their halos.
A task holds one slab with halos, one plane or one pencil, for all columns (coils) at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nufft
from .encode import _matrix, block_rows

#: Numbers that a task holds of the grid, at most, where one plane allows it.
HELD = 1 << 24
#: Samples of a slab that are spread in one task, at most.
SAMPLES = 1 << 16


class SlabTransform:
    """The transform of ``nodes`` (p, node array of one number for each axis) on a grid of ``shape``, ``columns`` of values at once.

    Cells are numbered row by row, the last axis fastest.  ``held`` bounds the numbers of a slab with its halos; a slab
    has at least one plane, so a task holds 2 * half planes at least.
    """

    def __init__(self, nodes: DataFrame, shape: tuple[int, ...], columns: int = 1, half: int = nufft.HALF, finer: float = nufft.FINER, held: int = HELD, samples: int = SAMPLES):
        if finer <= 1 or min(half, columns, held, samples, *shape) < 1:
            raise ValueError("the finer grid must be finer, and windows, columns, bounds and axes have a size")
        self.shape, self.columns, self.half = tuple(shape), columns, half
        self.fine = tuple(nufft.fine_size(n, half, finer) for n in shape)
        plane = int(np.prod(self.fine[1:])) * columns
        self.height = int(np.clip(held // plane - 2 * half + 1, 1, self.fine[0]))
        self.slabs = -(-self.fine[0] // self.height)
        row = int(np.prod(self.shape[1:]))
        self.chunk = int(np.clip(held // (self.fine[0] * columns), 1, row))
        first = F.floor(F.pmod(F.col("node")[0], F.lit(1.0)) * self.fine[0] / self.height).cast("int")
        placed = nodes.select("p", "node", F.least(first, F.lit(self.slabs - 1)).alias("slab"))
        counts = {r["slab"]: r["n"] for r in placed.groupBy("slab").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as planes at most
        # Nodes crowd in some slabs: such a slab is spread in parts.
        self.parts = [-(-counts.get(s, 0) // samples) for s in range(self.slabs)]
        parts = F.array(*[F.lit(max(n, 1)) for n in self.parts])[F.col("slab")]
        self.nodes = placed.withColumn("part", F.pmod(F.xxhash64("p"), parts).cast("int"))

    # ---- geometry, for tasks

    def _facts(self) -> dict:
        return {"shape": self.shape, "fine": self.fine, "half": self.half, "height": self.height, "columns": self.columns, "chunk": self.chunk, "slabs": self.slabs}

    def adjoint(self, values: DataFrame) -> DataFrame:
        """(cell, z) of values (p, z), z being re and im of each column in turn; samples without values are 0."""
        g = self._facts()
        rows = self.nodes.join(values.select("p", "z"), "p").select("slab", "part", "node", "z")
        planes = rows.groupBy("slab", "part").applyInArrow(_spread(**g), "i int, plane binary")
        # All that slabs made of one plane meets in one task, which adds it up as it streams past.
        pencils = planes.repartition("i").sortWithinPartitions("i").mapInArrow(_planes_to_pencils(**g), "b int, i int, x binary")
        return pencils.groupBy("b").applyInArrow(_pencils_to_cells(**g), "cell long, z array<double>")

    def forward(self, grid: DataFrame) -> DataFrame:
        """(p, z) of a grid (cell, z); cells without values are 0."""
        g = self._facts()
        row = int(np.prod(self.shape[1:]))
        cells = grid.select(F.floor(F.col("cell") % row / self.chunk).cast("int").alias("b"), F.col("cell").cast("long").alias("cell"), "z")
        pencils = cells.groupBy("b").applyInArrow(_cells_to_pencils(**g), "b int, i int, x binary")
        planes = pencils.repartition("i").sortWithinPartitions("i", "b").mapInArrow(_pencils_to_planes(**g), "i int, plane binary")
        # A plane goes to every part of every slab whose halo it lies in.
        spans = [(s, part, (s * self.height - self.half + 1 + r) % self.fine[0], r) for s, n in enumerate(self.parts) for part in range(n) for r in range(min(self.height + 2 * self.half - 1, self.fine[0]))]
        wanted = grid.sparkSession.createDataFrame(spans, "slab int, part int, i int, r int")
        planes = planes.join(wanted.hint("merge"), "i").select("slab", "part", "r", "plane")
        rows = self.nodes.select("slab", "part", "p", "node")
        return rows.groupBy("slab", "part").cogroup(planes.groupBy("slab", "part")).applyInArrow(_gather(**g), "p long, z array<double>")


def _z_column(z: np.ndarray) -> pa.ListArray:
    """Rows of complex numbers as lists of doubles."""
    flat = np.ascontiguousarray(z, complex).view(np.float64).reshape(len(z), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _complex_rows(column, rows: int) -> np.ndarray:
    return np.ascontiguousarray(_matrix(column, rows)).view(complex)


def _spots(shape: tuple[int, ...], fine: tuple[int, ...]) -> list[np.ndarray]:
    """Where the cells of each axis lie in the order of the FFT."""
    return [(np.arange(n) - n // 2) % m for n, m in zip(shape, fine, strict=True)]


def _in_slab(node: np.ndarray, slab: int, shape, fine, half, height) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a slab with its halo, and their weights, that each node's window has."""
    cells, weight = nufft.windows(node[:, 0], shape[0], fine[0], half)
    rows = min(height + 2 * half - 1, fine[0])
    place = (cells - (slab * height - half + 1)) % fine[0]
    if (place >= rows).any():
        raise ValueError("a node lies outside of its slab")
    for d in range(1, len(shape)):
        cell, w = nufft.windows(node[:, d], shape[d], fine[d], half)
        weight = (weight[:, :, None] * w[:, None, :]).reshape(len(node), -1)
        place = (place[:, :, None] * fine[d] + (cell % fine[d])[:, None, :]).reshape(len(node), -1)
    return place, weight


def _steps(n: int, half: int, axes: int) -> Iterator[slice]:
    step = max(nufft.HELD // (2 * half) ** axes, 1)
    for at in range(0, n, step):
        yield slice(at, at + step)


def _spread(shape, fine, half, height, columns, chunk, slabs):
    """applyInArrow: nodes and values of a part of a slab -> its planes, halo included."""
    rows, plane = min(height + 2 * half - 1, fine[0]), int(np.prod(fine[1:]))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        slab, n = key[0].as_py(), table.num_rows
        node, z = _matrix(table.column("node"), n), _complex_rows(table.column("z"), n)
        out = np.zeros((columns, rows * plane), complex)
        for part in _steps(n, half, len(shape)):
            place, weight = _in_slab(node[part], slab, shape, fine, half, height)
            place = place.ravel()
            for k in range(columns):
                y = (z[part, k, None] * weight).ravel()
                out[k] += np.bincount(place, y.real, rows * plane) + 1j * np.bincount(place, y.imag, rows * plane)
        out = out.reshape(columns, rows, plane).swapaxes(0, 1)
        some = np.flatnonzero(out.any(axis=(1, 2)))
        at = (slab * height - half + 1 + some) % fine[0]
        return pa.table({"i": pa.array(at.astype(np.int32)), "plane": pa.array([out[r].tobytes() for r in some], pa.binary())})

    return run


def _planes_to_pencils(shape, fine, half, height, columns, chunk, slabs):
    """mapInArrow over (i, plane) by i: planes added up, transformed within themselves, cropped, and cut into pencils' pieces."""
    spots, scales, axes = _spots(shape[1:], fine[1:]), [nufft.axis_scale(n, m, half) for n, m in zip(shape[1:], fine[1:], strict=True)], tuple(range(1, len(fine)))

    def pieces(i: int, plane: np.ndarray) -> pa.RecordBatch:
        x = plane.reshape(columns, *fine[1:])
        if axes:
            x = np.fft.fftn(x, axes=axes)[np.ix_(np.arange(columns), *spots)]
        for d, s in enumerate(scales):
            x = x * s.reshape(-1, *[1] * (len(scales) - 1 - d))
        x = x.reshape(columns, -1)
        starts = range(0, x.shape[1], chunk)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(starts), dtype=np.int32)), pa.array(np.full(len(starts), i, np.int32)), pa.array([x[:, a : a + chunk].tobytes() for a in starts], pa.binary())], names=["b", "i", "x"]
        )

    def run(batches):
        now, total = None, None
        for batch in batches:
            for row in block_rows(batch):
                if row["i"] != now:
                    if now is not None:
                        yield pieces(now, total)
                    now, total = row["i"], 0
                total = total + np.frombuffer(row["plane"], complex)
        if now is not None:
            yield pieces(now, total)

    return run


def _pencil(table: pa.Table, m: int, columns: int) -> np.ndarray:
    """(first axis, column, cell) of a pencil's pieces."""
    rows = [r for batch in table.combine_chunks().to_batches() for r in block_rows(batch)]
    size = len(rows[0]["x"]) // (16 * columns)
    out = np.zeros((m, columns, size), complex)
    for r in rows:
        out[r["i"]] = np.frombuffer(r["x"], complex).reshape(columns, size)
    return out


def _pencils_to_cells(shape, fine, half, height, columns, chunk, slabs):
    """applyInArrow: a pencil -> the grid's cells in it."""
    spot, scale, row = _spots(shape[:1], fine[:1])[0], nufft.axis_scale(shape[0], fine[0], half), int(np.prod(shape[1:]))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = np.fft.fft(_pencil(table, fine[0], columns), axis=0)[spot] * scale[:, None, None] / np.prod(fine)
        cell = np.arange(shape[0])[:, None] * row + key[0].as_py() * chunk + np.arange(x.shape[2])
        return pa.table({"cell": pa.array(cell.ravel()), "z": _z_column(x.swapaxes(1, 2).reshape(-1, columns))})

    return run


def _cells_to_pencils(shape, fine, half, height, columns, chunk, slabs):
    """applyInArrow: the grid's cells of a pencil -> its pieces for each plane, transformed along the first axis."""
    spot, scale, row = _spots(shape[:1], fine[:1])[0], nufft.axis_scale(shape[0], fine[0], half), int(np.prod(shape[1:]))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b, cell = key[0].as_py(), table.column("cell").to_numpy()
        x = np.zeros((fine[0], columns, min(chunk, row - b * chunk)), complex)
        # Equal cells add up.
        j = cell // row
        np.add.at(x, (spot[j], slice(None), cell % row - b * chunk), _complex_rows(table.column("z"), len(cell)) * scale[j][:, None])
        x = np.fft.ifft(x, axis=0)
        m = fine[0]
        return pa.table({"b": pa.array(np.full(m, b, np.int32)), "i": pa.array(np.arange(m, dtype=np.int32)), "x": pa.array([x[i].tobytes() for i in range(m)], pa.binary())})

    return run


def _pencils_to_planes(shape, fine, half, height, columns, chunk, slabs):
    """mapInArrow over (b, i, x) by i and b: planes of the finer grid, transformed within themselves."""
    spots, scales, row = _spots(shape[1:], fine[1:]), [nufft.axis_scale(n, m, half) for n, m in zip(shape[1:], fine[1:], strict=True)], int(np.prod(shape[1:]))

    def plane(i: int, x: np.ndarray) -> pa.RecordBatch:
        x = x.reshape(columns, *shape[1:])
        for d, s in enumerate(scales):
            x = x * s.reshape(-1, *[1] * (len(scales) - 1 - d))
        out = np.zeros((columns, *fine[1:]), complex)
        out[np.ix_(np.arange(columns), *spots)] = x
        if len(fine) > 1:
            out = np.fft.ifftn(out, axes=tuple(range(1, len(fine))))
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["i", "plane"])

    def run(batches):
        now, x = None, None
        for batch in batches:
            for r in block_rows(batch):
                if r["i"] != now:
                    if now is not None:
                        yield plane(now, x)
                    now, x = r["i"], np.zeros((columns, row), complex)
                piece = np.frombuffer(r["x"], complex).reshape(columns, -1)
                x[:, r["b"] * chunk : r["b"] * chunk + piece.shape[1]] = piece
        if now is not None:
            yield plane(now, x)

    return run


def _gather(shape, fine, half, height, columns, chunk, slabs):
    """Cogrouped applyInArrow: nodes of a part of a slab, and the slab's planes -> the transform at the nodes."""
    rows, plane = min(height + 2 * half - 1, fine[0]), int(np.prod(fine[1:]))

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        out = np.zeros((n, columns), complex)
        if n and right.num_rows:
            x = np.zeros((columns, rows, plane), complex)
            for batch in right.combine_chunks().to_batches():
                for r in block_rows(batch):
                    x[:, r["r"]] = np.frombuffer(r["plane"], complex).reshape(columns, plane)
            x, node = x.reshape(columns, -1), _matrix(left.column("node"), n)
            for part in _steps(n, half, len(shape)):
                place, weight = _in_slab(node[part], key[0].as_py(), shape, fine, half, height)
                for k in range(columns):
                    out[part, k] = (x[k][place] * weight).sum(axis=1)
        return pa.table({"p": left.column("p").combine_chunks().cast(pa.int64()), "z": _z_column(out)})

    return run
