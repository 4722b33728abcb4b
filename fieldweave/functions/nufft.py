"""Transforms between a Cartesian grid and arbitrary nodes, in numpy: exact and separable, or by gridding.

forward: f[p] = sum_j x[j] exp(2 pi i node_p . (j - shape // 2)), nodes in cycles per cell; adjoint: its adjoint.
"""

from __future__ import annotations

import numpy as np

#: Half width of the gridding window in cells of the finer grid, and how much finer that is.
HALF, FINER = 8, 2.0
#: Finer cells for each cell of a window up to which windows are rows of a matrix over all finer cells.
SMALL = 4
#: Numbers held at once beside the grids.
HELD = 1 << 21


class Separable:
    """The exact transform: a matrix whose rows are products of one exponential for each axis, a part of it at a time."""

    def __init__(self, nodes: np.ndarray, shape: tuple[int, ...]):
        self.nodes, self.shape = np.asarray(nodes, float), tuple(shape)
        if self.nodes.ndim != 2 or self.nodes.shape[1] != len(self.shape):
            raise ValueError("nodes must have one column for each axis")

    def _parts(self):
        """Rows of the matrix: a product of one exponential for each axis."""
        step = max(HELD // max(int(np.prod(self.shape)), 1), 1)
        for at in range(0, len(self.nodes), step):
            part = slice(at, at + step)
            rows = np.ones((len(self.nodes[part]), 1), complex)
            for d, n in enumerate(self.shape):
                e = np.exp(2j * np.pi * np.outer(self.nodes[part, d], np.arange(n) - n // 2))
                rows = (rows[:, :, None] * e[:, None, :]).reshape(len(rows), -1)
            yield part, rows

    def forward_many(self, x: np.ndarray) -> np.ndarray:
        """The transforms of the columns of x (cells by columns)."""
        out = np.empty((len(self.nodes), x.shape[1]), complex)
        for part, rows in self._parts():
            out[part] = rows @ x
        return out

    def adjoint_many(self, y: np.ndarray) -> np.ndarray:
        """The adjoint transforms of the columns of y (nodes by columns), cells by columns."""
        out = np.zeros((int(np.prod(self.shape)), y.shape[1]), complex)
        for part, rows in self._parts():
            out += rows.conj().T @ y[part]
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self.forward_many(x.reshape(-1, 1))[:, 0]

    def adjoint(self, y: np.ndarray) -> np.ndarray:
        return self.adjoint_many(y[:, None]).reshape(self.shape)


def fine_size(n: int, half: int = HALF, finer: float = FINER) -> int:
    """Cells of the finer grid for n cells of an axis."""
    return max(2 * int(np.ceil(finer * n / 2)), 2 * half)


def axis_scale(n: int, m: int, half: int) -> np.ndarray:
    """What each of n cells is multiplied by for the window on m finer cells."""
    b, k = np.pi * (2 - n / m), np.arange(n) - n // 2
    return m / np.i0(half * np.sqrt(b * b - (2 * np.pi * k / m) ** 2))


def windows(nodes: np.ndarray, n: int, m: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The 2 * half finer cells around each node of an axis (some below 0 or beyond m, as axes are rings) and their weights."""
    b, u = np.pi * (2 - n / m), (nodes % 1.0) * m
    cell = np.floor(u)[:, None] + np.arange(1 - half, half + 1)
    root = np.sqrt(np.maximum(half**2 - (u[:, None] - cell) ** 2, 0))
    safe = np.where(root > 0, root, 1)
    return cell.astype(np.int64), np.where(root > 0, np.sinh(b * safe) / (np.pi * safe), b / np.pi)


class Gridding:
    """The transform by a finer FFT and a window of 2 * half cells on each axis (sinh window, Bessel weights)."""

    def __init__(self, nodes: np.ndarray, shape: tuple[int, ...], half: int = HALF, finer: float = FINER):
        if finer <= 1 or half < 1:
            raise ValueError("the finer grid must be finer and the window have a width")
        self.nodes, self.shape, self.half = np.asarray(nodes, float), tuple(shape), half
        if self.nodes.ndim != 2 or self.nodes.shape[1] != len(self.shape):
            raise ValueError("nodes must have one column for each axis")
        self.fine = tuple(fine_size(n, half, finer) for n in self.shape)
        self.weights, self.places, scale = [], [], []
        for d, (n, m) in enumerate(zip(self.shape, self.fine, strict=True)):
            scale.append(axis_scale(n, m, half))
            cell, weight = windows(self.nodes[:, d], n, m, half)
            self.weights.append(weight)
            self.places.append(cell % m)
        self.scale = scale[0]
        for s in scale[1:]:
            self.scale = self.scale[..., None] * s
        # Cell j - n // 2 of the grid in the order of the FFT.
        self.spot = np.ix_(*[(np.arange(n) - n // 2) % m for n, m in zip(self.shape, self.fine, strict=True)])

    def _small(self) -> bool:
        """Whether windows cover so much of the finer grid that matrix products over all of it take less time."""
        return int(np.prod(self.fine)) <= SMALL * (2 * self.half) ** len(self.shape)

    def _rows(self):
        """Windows as rows of a real matrix over all finer cells, a part of them at a time."""
        step = max(HELD // int(np.prod(self.fine)), 1)
        for at in range(0, len(self.nodes), step):
            part = slice(at, at + step)
            rows = np.ones((len(self.nodes[part]), 1))
            for w, p, m in zip(self.weights, self.places, self.fine, strict=True):
                axis = np.zeros((len(rows), m))
                np.put_along_axis(axis, p[part], w[part], axis=1)  # an axis has at least as many cells as a window
                rows = (rows[:, :, None] * axis[:, None, :]).reshape(len(rows), -1)
            yield part, rows

    def _parts(self):
        step = max(HELD // (2 * self.half) ** len(self.shape), 1)
        for at in range(0, len(self.nodes), step):
            part = slice(at, at + step)
            weight, place = self.weights[0][part], self.places[0][part]
            for w, p, m in zip(self.weights[1:], self.places[1:], self.fine[1:], strict=True):
                weight = (weight[:, :, None] * w[part][:, None, :]).reshape(len(weight), -1)
                place = (place[:, :, None] * m + p[part][:, None, :]).reshape(len(place), -1)
            yield part, weight, place

    def forward_many(self, x: np.ndarray) -> np.ndarray:
        """The transforms of the columns of x (cells by columns): one FFT, the windows' weights computed once for all."""
        m = x.shape[1]
        fine = np.zeros((*self.fine, m), complex)
        fine[self.spot] = x.reshape(*self.shape, m) * self.scale[..., None]
        fine = np.fft.ifftn(fine, axes=range(len(self.shape))).reshape(-1, m)
        out = np.empty((len(self.nodes), m), complex)
        if self._small():
            for part, rows in self._rows():
                out[part] = (rows @ np.ascontiguousarray(fine).view(float)).view(complex)
            return out
        for part, weight, place in self._parts():
            for k in range(m):
                out[part, k] = (fine[:, k][place] * weight).sum(axis=1)
        return out

    def adjoint_many(self, y: np.ndarray) -> np.ndarray:
        """The adjoint transforms of the columns of y (nodes by columns), cells by columns."""
        size, m = int(np.prod(self.fine)), y.shape[1]
        if self._small():
            fine = np.zeros((size, 2 * m))
            for part, rows in self._rows():
                fine += rows.T @ np.ascontiguousarray(y[part], complex).view(float)
            fine = np.fft.fftn(fine.view(complex).reshape(*self.fine, m), axes=range(len(self.shape)))
            return (fine[self.spot] * self.scale[..., None] / size).reshape(-1, m)
        fine = np.zeros((m, size), complex)
        for part, weight, place in self._parts():
            place = place.ravel()
            for k in range(m):
                z = (y[part, k, None] * weight).ravel()
                fine[k] += np.bincount(place, z.real, size) + 1j * np.bincount(place, z.imag, size)
        fine = np.fft.fftn(fine.reshape(m, *self.fine), axes=range(1, len(self.shape) + 1))
        return (np.moveaxis(fine, 0, -1)[self.spot] * self.scale[..., None] / size).reshape(-1, m)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self.forward_many(x.reshape(-1, 1))[:, 0]

    def adjoint(self, y: np.ndarray) -> np.ndarray:
        return self.adjoint_many(y[:, None]).reshape(self.shape)


def cheaper(nodes: np.ndarray, shape: tuple[int, ...]) -> Separable | Gridding:
    """The transform that takes fewer multiplications for one column."""
    fine = np.prod([fine_size(n) for n in shape])
    gridded = fine * np.log2(fine) * 5 + len(nodes) * (2 * HALF) ** len(shape)
    return Separable(nodes, shape) if len(nodes) * np.prod(shape) <= 4 * gridded else Gridding(nodes, shape)


KERNELS = {"separable": Separable, "gridding": Gridding, "auto": cheaper}


def centre_phase(nodes: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """exp(2 pi i node / 2) for every even axis: centred cells lie half a cell beyond j - n // 2 there."""
    even = np.array([0.5 if n % 2 == 0 else 0.0 for n in shape])
    return np.exp(2j * np.pi * (nodes @ even))
