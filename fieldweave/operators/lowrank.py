"""Products with low-rank encoding: exact or gridded Fourier terms times factors of what is left.

y[p, c] = sum_r q[p, r] sum_v x[v] csm[v, c] conj(S[v, r]) exp(2 pi i k_p . r_v)

where k_p . r_v are the first-order terms (two of them on a single slice) on a Cartesian grid, and
q S^H stands for all other terms but n^-1/2 and the zeroth-order phase.

The grid is cut into tiles.  The voxels of a tile are one block (or several) that holds their spatial
factors once, for all ranks, and their maps, for all coils; the samples are blocks that hold nodes and
temporal factors.  Voxel blocks are written once, bucketed, and stay where they are: image values and
sample blocks come to them.  Where two blocks meet, one transform between the tile and the block's
nodes serves all coils and ranks, and the signal is summed over all ranks there, before anything
weighs it; what is shuffled is those sums.

Samples of one readout, time and coefficients have the same rows of the operator, and voxels of one cell and equal basis values
the same columns but for their maps.  Where there are such copies (as explicit products tell), both are classes: values times maps are
added up by class before the product, and each member gets its class's sum, times its own maps, after it.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import cplx, nufft
from . import factors
from .encode import CACHE_BYTES, SAMPLES, Adjoint, Classes, _complex, _real, _sums, axpby, block_rows, dealt, packed

METHODS = ("per_readout", "incremental_shared", "direct_shared")


@dataclass(frozen=True)
class Options:
    """How the factors are made; ``check`` refuses what does not go together."""

    method: str = "incremental_shared"
    strategy: str | None = None
    rank: int = 15
    oversample: int = 5
    tol: float = 1e-2
    most: int = 128
    seed: int = 1234
    eps: float | None = None
    roi_tol: float | None = None
    recompress_tol: float | None = None
    recompress_rank: int | None = None
    weights: np.ndarray | None = None
    coil_weighting: bool = False
    fit_samples: int | None = None
    readout_count: int | None = None
    keep_bytes: int = 0

    def check(self, readouts: int, samples: int) -> Options:
        def refuse(when: bool, why: str) -> None:
            if when:
                raise ValueError(why)

        direct, again = self.method == "direct_shared", self.recompress_tol is not None or self.recompress_rank is not None
        everywhere = direct and self.strategy == "global"
        refuse(self.method not in METHODS, f"unknown method: {self.method}")
        refuse(self.strategy is not None and not direct, "a strategy needs the method direct_shared")
        refuse(self.strategy not in (None, "per_readout", "global"), f"unknown strategy: {self.strategy}")
        refuse(self.rank < 1 or self.oversample < 0 or self.most < 1 or self.tol <= 0, "ranks and tolerances must be positive")
        refuse(not direct and self.method != "per_readout" and self.rank + self.oversample > samples, "rank and oversampling exceed the samples of a readout")
        refuse(everywhere and (self.eps is None or not 0 < self.eps < 1), "the global strategy needs eps between 0 and 1")
        refuse(everywhere and self.roi_tol is not None, "the global strategy has no tolerance for a region")
        refuse(not everywhere and self.eps is not None, "eps needs the global strategy")
        refuse(self.roi_tol is not None and not direct, "a tolerance for a region needs the method direct_shared")
        refuse(self.recompress_tol is not None and self.recompress_rank is not None, "recompress by a tolerance or to a rank, not both")
        refuse(self.recompress_tol is not None and self.recompress_tol < 0, "tolerances start from 0")
        refuse(self.recompress_rank is not None and self.recompress_rank < 1, "ranks must be positive")
        refuse(again and self.method != "incremental_shared", "only an incremental shared basis can be recompressed")
        refuse((self.weights is not None or self.coil_weighting) and not again, "weights need a recompression")
        refuse(self.fit_samples is not None and self.method != "incremental_shared", "sampled fits need an incremental shared basis")
        refuse(self.fit_samples is not None and self.fit_samples < 1, "there must be voxels to fit")
        refuse(self.readout_count is not None and (self.fit_samples is None or not 1 <= self.readout_count <= readouts), "a choice of readouts needs a sampled fit and as many readouts")
        refuse(self.keep_bytes < 0 or (self.keep_bytes > 0 and self.method != "per_readout"), "only factors of single readouts are kept in part")
        return self


def build(options: Options, voxels: DataFrame, readouts: list[factors.Rows | np.ndarray], csm: DataFrame | None = None, classes: Classes | None = None,
          maker: list | None = None) -> tuple[np.ndarray, DataFrame, dict]:
    """q, the spatial factor (v, s) or (d, v, s), and a report, by the method of ``options``; voxels may be ``classes`` of those of the maps.

    ``maker`` gets what makes the factors of single readouts where voxels lie, unless some of them are kept.
    """
    o = options.check(len(readouts), max(map(len, readouts)))
    if o.method == "per_readout":
        q, basis = factors.per_readout(voxels, readouts, o.rank, o.oversample, o.seed, o.keep_bytes, maker=None if o.keep_bytes else maker)
        return q, basis, {"rank": q.shape[1]}
    if o.method == "direct_shared":
        if o.strategy == "global":
            q, basis, trials = factors.adaptive_factors(voxels, readouts, o.eps, most=o.most, seed=o.seed)
            report = {"trials": trials, "passed": q is not None}
        else:
            q, basis, report = factors.joint_basis(voxels, readouts, o.tol, most=o.most, roi_tol=o.roi_tol, seed=o.seed)
        if q is None:
            raise ValueError(f"no direct basis within the budget: {report}")
        return q, basis, report
    if o.fit_samples is not None:
        q, basis, report = factors.sampled_shared(voxels, readouts, o.rank, o.readout_count, o.fit_samples, o.tol, o.most, o.oversample, o.seed)
    else:
        us, coeff, basis = factors.shared_factors(voxels, readouts, o.rank, o.tol, o.most, o.oversample, o.seed)
        q, report = factors.assemble(us, coeff), {"rank": coeff[0].shape[0]}
    if o.recompress_tol is not None or o.recompress_rank is not None:
        weight = None
        if o.coil_weighting:
            energy = csm.groupBy("v").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("w"))
            if classes is not None and classes.members is not None:
                energy = classes.of(energy).groupBy("v").agg(F.sum("w").alias("w")).join(voxels.select("v", "n"), "v").select("v", (F.col("w") / F.col("n")).alias("w"))
            basis, weight = basis.join(energy, "v"), "w"
        q, basis, error = factors.recompress(q, basis, o.recompress_tol, o.recompress_rank, o.weights, weight, factors.Rows.joined(readouts))
        report |= {"rank": q.shape[1], "recompression_error": error}
    return q, basis, report


def residual_terms(n_terms: int, flat: bool) -> range:
    """Numbers (from 0) of the terms that the factors stand for; on a single slice the third first-order term is one of them."""
    return range(3 if flat else 4, n_terms)


def full_options(voxels: DataFrame, samples: DataFrame, n_terms: int, flat: bool, **more) -> Options:
    """Options of as many ranks as doubles can tell apart, at most those of the longest readout's samples: nothing is left out."""
    longest = samples.groupBy("d").count().agg(F.max("count")).first()[0]
    rows = factors.rows_by_readout(readout_features(samples, n_terms, flat))[2]
    most = max(len(x.f) for x in rows)
    if most > 256:
        most = min(most, factors.full_rank(factors.distinct_voxels(voxel_features(voxels, n_terms, flat)), factors.Rows.joined(rows)))
    return Options(rank=min(most, longest), oversample=0, **more)


def phase_features(samples: pd.DataFrame, n_terms: int, flat: bool) -> np.ndarray:
    """Temporal features: time and the residual coefficients."""
    k = np.stack(samples["k"].to_numpy())
    return np.column_stack([samples["t"].to_numpy(), k[:, list(residual_terms(n_terms, flat))]])


def temporal_features(samples: DataFrame, n_terms: int, flat: bool) -> DataFrame:
    """(p, f): time and the residual coefficients, as a table."""
    at = residual_terms(n_terms, flat)
    return samples.select("p", F.concat(F.array("t"), F.slice("k", at.start + 1, len(at))).alias("f"))


def readout_features(samples: DataFrame, n_terms: int, flat: bool) -> DataFrame:
    """(d, p, f): the same beside the readout."""
    at = residual_terms(n_terms, flat)
    return samples.select("d", "p", F.concat(F.array("t"), F.slice("k", at.start + 1, len(at))).alias("f"))


def voxel_features(voxels: DataFrame, n_terms: int, flat: bool) -> DataFrame:
    """(v, g[, n]): b0 and the residual basis functions."""
    at = residual_terms(n_terms, flat)
    return voxels.select("v", F.concat(F.array("b0"), F.slice("b", at.start + 1, len(at))).alias("g"), *[c for c in voxels.columns if c == "n"])


def spatial_features(voxels: DataFrame, n_terms: int, flat: bool) -> DataFrame:
    """The same, dealt to tasks for the making of factors."""
    return factors.spread(voxel_features(voxels, n_terms, flat))


#: Voxels of a block, cells of a tile, and bytes of a block's factors and maps, at most.
VOXELS, CELLS, BLOCK_BYTES = 8192, 8192, 16 << 20
#: Numbers of a tile's columns that one transform takes at once.
HELD = 1 << 22


class LowRankOp:
    """The operator of samples (p, d, t, k) on voxels (v, ix, iy, iz, b0, b) of a grid, with coil maps (v, c, re, im).

    ``shape`` and ``spacing`` are those of the grid; voxels may share cells.  ``options`` choose the factors, ``kernel`` the
    transform (``auto``: whichever is cheaper for a tile and the nodes that meet), ``centre`` whether cells of even axes lie half
    a cell off (they do on centred grids), ``ranks`` and ``coils`` how many of them a transform takes at once, ``cells`` how many
    cells a tile has at most.  ``hold_bytes`` of voxel blocks may be written once; beyond that each product makes them anew.
    ``tables`` are factors that are there already, as ``tallfactors.rsvd`` makes them: q (p, q) and s (v, s) of the residual phases; then no
    sample passes through the driver.  A function makes them from voxels (v, g, n) and samples (p, f, n), rows that stand for n equal ones.
    """

    def __init__(self, samples: DataFrame, voxels: DataFrame, shape: tuple[int, int, int], spacing: tuple[float, float, float], n_terms: int = 9,
                 csm: DataFrame | None = None, options: Options = Options(), kernel: str = "auto", centre: bool = True, ranks: int = 16, coils: int = 8,
                 cells: int = CELLS, hold_bytes: int = CACHE_BYTES, tables: tuple[DataFrame, DataFrame] | Callable | None = None):
        if n_terms not in (9, 13, 16, 20) or kernel not in nufft.KERNELS or min(ranks, coils, cells, *shape) < 1:
            raise ValueError("no such number of terms, kernel, group or grid")
        self.samples, self.voxels, self.csm, self.ranks, self.coils, self.kernel, self.hold_bytes = samples, voxels, csm, ranks, coils, kernel, hold_bytes
        self.count = voxels.count()
        if not self.count:
            raise ValueError("no voxels")
        flat = shape[2] == 1
        self.grid, self.axes, self.spacing, self.centre = shape, 2 if flat else 3, spacing, centre
        counts = samples.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("p")).first()
        self.sample_count = counts["n"]
        if not self.sample_count or counts["p"] != self.sample_count:
            raise ValueError("samples must be there and numbered uniquely")
        self._maker: factors.Spatial | None = None
        self._find_classes(n_terms, own=tables is None, copies=tables is None or callable(tables))
        if callable(tables):
            tables = tables(factors.spread(voxel_features(self._voxels, n_terms, flat), True), temporal_features(self._samples, n_terms, flat))
        if tables is not None:
            self.temporal, self.basis = tables[0].select("p", F.lit(0).alias("set"), "q"), tables[1]
            self.rank, self.own, self.sets, longest = len(tables[0].first()["q"]) // 2, False, 1, self._s.count
            self.report = {"rank": self.rank}
        else:
            longest = self._fit(n_terms, options, csm)
        self.coil_count = 1 if csm is None else csm.agg(F.max("c").alias("c")).first()["c"] + 1
        self.sample_blocks = -(-longest // SAMPLES)
        self._lay_tiles(cells)
        self._blocks: shared.Bucketed | DataFrame | None = None
        self._products = 0
        self._normal: NormalOp | None = None

    def _find_classes(self, n_terms: int, own: bool, copies: bool) -> None:
        """Classes of samples (by readout, if they may have factors of their ``own``) and voxels, and their first members as tables with n, how many there are."""
        f = F.struct(*(["d"] if own else []), F.col("t").cast("double"), F.slice(F.col("k").cast("array<double>"), 1, n_terms).alias("k"))
        g = F.struct("ix", "iy", "iz", F.col("b0").cast("double"), F.slice(F.col("b").cast("array<double>"), 1, n_terms).alias("b"))
        found = []
        for df, id_, key, count in ((self.samples, "p", f, self.sample_count), (self.voxels, "v", g, self.count)):
            distinct = df.agg(F.approx_count_distinct(F.xxhash64(key), 0.02).alias("n")).first()["n"] if copies else count
            c = Classes(df, id_, key, count, distinct)
            rows = df.withColumn("n", F.lit(1).cast("long")) if c.members is None else shared.cut(df.join(c.members.groupBy(F.col("rep").alias(id_)).agg(F.count(F.lit(1)).alias("n")), id_))
            found.append((c, rows))
        (self._s, self._samples), (self._v, self._voxels) = found

    def _fit(self, n_terms: int, options: Options, csm: DataFrame | None) -> int:
        """Makes the factors; returns the number of samples (classes) of the longest set.  Features of the classes of samples pass through the driver."""
        flat = self.axes == 2
        names, reps, readouts = factors.rows_by_readout(readout_features(self.samples, n_terms, flat))
        voxels = factors.spread(voxel_features(self._voxels, n_terms, flat), self._v.members is not None)
        maker: list[factors.Spatial] = []
        self.q, self.basis, self.report = build(options, voxels, readouts, csm, self._v, maker)
        if maker:
            self._maker, self._features = maker[0], voxel_features(self._voxels, n_terms, flat)
        self.own, self.rank = "d" in self.basis.columns, self.q.shape[1]
        self.sets = len(readouts) if self.own else 1
        # Samples of one class of the products have equal residual features, too: they find their factors by them.
        place = np.repeat(np.arange(len(names)), [len(x) for x in reps])
        table = _temporal(self.samples.sparkSession, np.concatenate(reps), place if self.own else np.zeros(len(place)), self.q).withColumnRenamed("p", "rep")
        rows = readout_features(self._samples, n_terms, flat)
        found = readout_features(self.samples, n_terms, flat).groupBy("d", "f").agg(F.min("p").alias("rep"))
        self.temporal = shared.cut(rows.join(found, ["d", "f"]).select("p", "rep").join(table, "rep").select("p", "set", "q"))
        counts = self._samples.groupBy("d").count().agg(F.max("count").alias("m"), F.sum("count").alias("n")).first()
        return counts["m"] if self.own else counts["n"]

    @property
    def shape(self) -> tuple[int, int]:
        """Rows (samples by coils) and columns (voxels)."""
        return self.sample_count * self.coil_count, self.count

    @property
    def H(self) -> Adjoint:  # noqa: N802
        return Adjoint(self)

    # ---- blocks

    def _lay_tiles(self, cells: int) -> None:
        """Cuts the longest axis of the tiles in half until they are small enough and there are enough for all cores."""
        cores, tile = self.voxels.sparkSession.sparkContext.defaultParallelism, list(self.grid)
        number = lambda: int(np.prod([-(-n // t) for n, t in zip(self.grid, tile, strict=True)]))
        while max(tile) > 1 and (np.prod(tile) > cells or number() * self.sets < 2 * cores and np.prod(tile) > 64):
            axis = int(np.argmax(tile))
            tile[axis] = -(-tile[axis] // 2)
        self.tile, self.tiles = tuple(tile), number()
        most = max(min(VOXELS, BLOCK_BYTES // (16 * (self.rank + self.coil_count))), 64)
        self.parts = max(-(-self._v.count // (self.tiles * most)), 1)
        self.voxel_blocks = self.tiles * self.parts

    def _placed(self) -> DataFrame:
        """Voxels with the number of their tile's part and their cell in the tile."""
        (tx, ty, tz), (nx, ny, _) = self.tile, self.grid
        at = lambda n, t: F.floor(F.col(n) / t).cast("int")
        tile = (at("iz", tz) * -(-ny // ty) + at("iy", ty)) * -(-nx // tx) + at("ix", tx)
        cell = (F.col("iz") % tz * ty + F.col("iy") % ty) * tx + F.col("ix") % tx
        return self._voxels.select("v", (tile * self.parts + dealt("v", self.parts)).alias("tile"), cell.alias("cell"))

    def _voxel_blocks(self) -> DataFrame:
        """(vb, vs, cell, s or feat, m): the blocks of every set of factors, from where they are held or made anew.

        Factors of single readouts are made in the blocks: until those are held, from the third product on (what a normal product reads is not
        worth writing), they have features (feat) instead, and the factors are made where blocks meet.  No factor is shuffled.
        """
        self._products += 1
        if self._blocks is None:
            blocks = self._packed_blocks()
            need = 16 * self._v.count * (self.rank * self.sets + self.coil_count)
            if need > self.hold_bytes or (self._maker is not None and self._products <= 2):
                return blocks
            self._blocks = shared.Bucketed(blocks, "vb", (lambda df: df) if self._maker is None else lambda df: df.mapInArrow(*self._made(df)))
        return self._blocks.read() if isinstance(self._blocks, shared.Bucketed) else self._blocks

    def _packed_blocks(self) -> DataFrame:
        """(vb, vs, cell, s or feat, m): blocks of every set; those whose factors are made in them have features instead, dealt to the sets' tasks."""
        rows, columns = self._placed(), {"cell": F.array(F.col("cell"))}
        rows = rows.join(self.basis, "v") if self._maker is None else rows.join(self._features.select("v", "g"), "v")
        columns |= {"s": F.col("s")} if self._maker is None else {"feat": F.col("g")}
        # Members of a class have maps of their own: those are taken before and after the product.
        if self._v.members is None:
            columns["m"] = F.array(F.lit(1.0), F.lit(0.0))
            if self.csm is not None:
                rows = rows.join(coil_arrays(self.csm, "v", self.coil_count).withColumnRenamed("z", "m"), "v", "left")
                columns["m"] = F.coalesce("m", F.array(*[F.lit(0.0)] * (2 * self.coil_count)))
        if self._maker is None:
            return packed(rows, "v", columns, (F.col("d") * self.voxel_blocks if self.own else F.lit(0)) + F.col("tile"), "vb")
        blocks, n = packed(rows, "v", columns, F.col("tile"), "tile"), self.voxel_blocks
        every = F.explode(F.sequence(F.col("tile"), F.col("tile") + n * (self.sets - 1), F.lit(n))).alias("vb")
        return blocks.select(every, *[c for c in blocks.columns if c != "tile"]).repartition(self._tasks(), "vb")

    def _made(self, blocks: DataFrame) -> tuple[Callable, str]:
        """mapInArrow over blocks of features, and its schema: their factors instead."""
        maker, n, names = self._maker, self.voxel_blocks, [c if c != "feat" else "s" for c in blocks.columns]

        def run(batches):
            for batch in batches:
                for i, row in enumerate(block_rows(batch)):
                    s = maker(row["vb"] // n, _real(row["feat"], len(row["vs"]) // 8))
                    kept = [pa.array([s.tobytes()], pa.binary()) if c == "s" else batch.column(c).slice(i, 1) for c in names]
                    yield pa.RecordBatch.from_arrays(kept, names=names)

        return run, ", ".join("vb int" if c == "vb" else f"{c} binary" for c in names)

    def _sample_blocks(self, signal: DataFrame | None = None) -> DataFrame:
        """(sb, ps, node, fold, q[, y]): blocks of samples by set of factors, with the phase that their zeroth-order terms and grid have."""
        node = [F.col("k")[1 + i] * self.spacing[i] for i in range(self.axes)]
        fold = F.col("k")[0]
        for i in range(self.axes):
            if self.centre and self.grid[i] % 2 == 0:
                fold = fold + 0.5 * node[i]
        rows, more = self._samples.select("p", "k").join(self.temporal, "p"), {}
        if signal is not None:
            signal = self._s.of(signal.select("p", "c", "re", "im"))
            rows = rows.join(coil_arrays(signal, "p", self.coil_count).withColumnRenamed("z", "y"), "p", "left")
            more = {"y": F.coalesce("y", F.array(*[F.lit(0.0)] * (2 * self.coil_count)))}
        block = F.col("set") * self.sample_blocks + dealt("p", self.sample_blocks)
        # Axes in the order of a tile's cells.
        return packed(rows, "p", {"node": F.array(*node[::-1]), "fold": F.array(fold), "q": F.col("q"), **more}, block, "sb")

    def _images(self, image: DataFrame) -> DataFrame:
        """(tile, x): image values of each part of a tile, in the order of its voxels; 0 where there is none.  Classes have the sums of values times maps, by coil."""
        if self._v.members is not None:
            values = image.select("v", F.lit(0).alias("c"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
            if self.csm is not None:
                values = values.drop("c").join(self.csm.select("v", "c", F.col("re").alias("cr"), F.col("im").alias("ci")), "v")
                re, im = cplx.mul((F.col("re"), F.col("im")), (F.col("cr"), F.col("ci")))
                values = values.select("v", "c", re.alias("re"), im.alias("im"))
            sums = coil_arrays(self._v.of(values), "v", self.coil_count)
            rows = self._placed().join(sums, "v", "left")
            return packed(rows, "v", {"x": F.coalesce("z", F.array(*[F.lit(0.0)] * (2 * self.coil_count)))}, F.col("tile"), "tile").select("tile", "x")
        rows = self._placed().join(image.select("v", F.array(F.col("re").cast("double"), F.col("im").cast("double")).alias("x")), "v", "left")
        return packed(rows, "v", {"x": F.coalesce("x", F.array(F.lit(0.0), F.lit(0.0)))}, F.col("tile"), "tile").select("tile", "x")

    def _in_every_set(self, values: DataFrame) -> DataFrame:
        """(vb, x): the values of each tile beside the factors of every set."""
        n = self.voxel_blocks
        return values.select(F.explode(F.sequence(F.col("tile"), F.col("tile") + n * (self.sets - 1), F.lit(n))).alias("vb"), "x")

    def _pairs(self, samples: DataFrame, image: DataFrame | None = None) -> DataFrame:
        """Every voxel block beside every sample block of its set, where the voxel block lies."""
        n, m = self.voxel_blocks, self.sample_blocks
        pairs = self._voxel_blocks()
        if image is not None:
            pairs = pairs.join(self._in_every_set(self._images(image)).hint("merge"), "vb")
        first = F.floor(F.col("sb") / m).cast("int") * n
        own = samples.withColumn("vb", F.explode(F.sequence(first, first + n - 1)))
        if "feat" in pairs.columns:
            own = own.repartition(self._tasks(), "vb")
        return pairs.join(own.hint("merge"), "vb")

    def _tasks(self) -> int:
        return 4 * self.voxels.sparkSession.sparkContext.defaultParallelism

    def _pair(self) -> Pair:
        return Pair(self._kernel(), self.ranks, self.coils, self._maker, self.voxel_blocks)

    def _kernel(self) -> Callable:
        """A pair of blocks -> its transform and the samples' phases; for tasks."""
        grid, tile, parts, n, kernel, norm = self.grid[: self.axes], self.tile[: self.axes], self.parts, self.voxel_blocks, nufft.KERNELS[self.kernel], self.count**-0.5
        counts = [-(-g // t) for g, t in zip(grid, tile, strict=True)]

        def of(row: dict, m: int):
            node, fold = _real(row["node"], m), _real(row["fold"], m)[:, 0]
            at, origin = row["vb"] % n // parts, []
            for c, t in zip(counts, tile, strict=True):
                origin.append(at % c * t)
                at //= c
            # The transform's cells are numbered from the middle of the tile.
            shift = np.array([o + t // 2 - g // 2 for o, t, g in zip(origin, tile, grid, strict=True)][::-1])
            return kernel(node, tile[::-1]), np.exp(2j * np.pi * (fold + node @ shift)) * norm

        return of

    # ---- products

    def forward(self, image: DataFrame) -> DataFrame:
        """Signal (p, c, re, im) of an image (v, re, im); voxels without a value are 0."""
        pairs = self._pairs(self._sample_blocks(), image)
        rows = pairs.mapInArrow(_sums("sb", "ps", self._pair().signals), "id long, c int, re double, im double")
        return self._s.each(rows.groupBy(F.col("id").alias("p"), "c").agg(F.sum("re").alias("re"), F.sum("im").alias("im")))

    def adjoint(self, signal: DataFrame, grid: DataFrame | None = None) -> DataFrame:
        """Image (v, re, im) of a signal (p, c, re, im); missing samples are 0; on ``grid`` (v) voxels outside are 0."""
        pairs = self._pairs(self._sample_blocks(signal))
        rows = pairs.mapInArrow(_sums("vb", "vs", self._pair().images), "id long, c int, re double, im double")
        out = self._members_images(rows.withColumnRenamed("id", "v"))
        if grid is None:
            return out
        zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
        return grid.select("v").join(out, "v", "left").select("v", zero("re"), zero("im"))

    def _members_images(self, rows: DataFrame) -> DataFrame:
        """Parts (v, c, re, im) of the image added up; those of classes go to each member, whose maps weigh their coils."""
        if self._v.members is None:
            return rows.groupBy("v").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        sums = self._v.each(rows.groupBy("v", "c").agg(F.sum("re").alias("re"), F.sum("im").alias("im")))
        if self.csm is None:
            return sums.select("v", "re", "im")
        sums = sums.join(self.csm.select("v", "c", F.col("re").alias("cr"), F.col("im").alias("ci")), ["v", "c"], "left")
        re, im = cplx.mul((F.col("re"), F.col("im")), (F.coalesce("cr", F.lit(0.0)), -F.coalesce("ci", F.lit(0.0))))
        return sums.groupBy("v").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))

    def normal(self, image: DataFrame, weights: DataFrame | None = None, by: str = "rank") -> DataFrame:
        """A^H D A x with ``weights`` (p[, c], w), real and not negative.

        ``rank`` sums the signal over all ranks and voxel blocks before it is weighted, and shuffles those sums;
        ``readout`` does a readout with factors of its own from image to image in one task, with
        all its voxels, and shuffles no signal; ``channel`` does so for each group of coils, with a copy of the factors for each.
        """
        if by not in ("rank", "channel", "readout") or (by == "readout" and not self.own):
            raise ValueError(f"normal products cannot go by {by} here")
        d = normal_weights(weights, self.samples, self.coil_count)
        if by == "rank":
            y = self.forward(image)
            if d is not None:
                y = y.join(d, "p").select("p", "c", (F.col("re") * F.col("w")).alias("re"), (F.col("im") * F.col("w")).alias("im"))
            return self.adjoint(y)
        groups = -(-self.coil_count // self.coils) if by == "channel" else 1
        every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        n, m = self.voxel_blocks, self.sample_blocks
        left = self._voxel_blocks().join(self._in_every_set(self._images(image)).hint("merge"), "vb").withColumns({"set": F.floor(F.col("vb") / n), "g": every})
        rows = self._sample_blocks()
        if self._s.members is not None:
            d = self._samples.select("p", F.col("n").cast("double").alias("w")) if d is None else self._s.of(d).groupBy("p").agg(F.sum("w").alias("w"))
        if d is not None:
            weighed = packed(self.temporal.select("p", "set").join(d, "p"), "p", {"w": F.array("w")}, F.col("set") * m + dealt("p", m), "sb").select("sb", "w")
            rows = rows.join(weighed, "sb")
        right = rows.withColumns({"set": F.floor(F.col("sb") / m), "g": every})
        run = _image_to_image(self._pair(), self.coils if by == "channel" else self.coil_count)
        out = left.groupBy("set", "g").cogroup(right.groupBy("set", "g")).applyInArrow(run, "v long, c int, re double, im double")
        return self._members_images(out)

    def mul(self, image: DataFrame, out: DataFrame | None = None, alpha: complex = 1.0, beta: complex = 0.0) -> DataFrame:
        """alpha A x + beta out."""
        return axpby(self.forward(image), out, ["p", "c"], alpha, beta)

    # ---- normal operators

    def normal_operator(self, weights: DataFrame | None = None, by: str = "rank") -> NormalOp:
        """A^H D A as an operator; until it is released no other weights are taken."""
        if self._normal is None:
            self._normal = NormalOp(self, weights, by)
        elif not self._normal.same(weights, by):
            raise ValueError("there is a normal operator with other weights; release it first")
        return self._normal

    def release(self) -> None:
        """Lets go of the normal operator, if there is one; it cannot be used any more."""
        if self._normal is not None:
            self._normal.op, self._normal = None, None

    def close(self) -> None:
        """Lets go of the normal operator and deletes the voxel blocks; later products make them anew."""
        self.release()
        if isinstance(self._blocks, shared.Bucketed):
            self._blocks.drop()
        self._blocks = None


class NormalOp:
    """A^H D A of an operator with weights fixed."""

    def __init__(self, op: LowRankOp, weights: DataFrame | None, by: str):
        self.op, self.by, self.weights = op, by, weights
        self.values = normal_weights(weights, op.samples, op.coil_count)

    def same(self, weights: DataFrame | None, by: str) -> bool:
        other = normal_weights(weights, self.op.samples, self.op.coil_count)
        if by != self.by or (other is None) != (self.values is None):
            return False
        return other is None or self.values.join(other.withColumnRenamed("w", "o"), "p", "full").where("not (w <=> o)").isEmpty()

    def forward(self, image: DataFrame) -> DataFrame:
        if self.op is None:
            raise ValueError("the normal operator was released")
        return self.op.normal(image, self.weights, self.by)

    adjoint = forward


class Pair:
    """Products of a voxel block and a sample block, all ranks and coils by one transform, some columns at a time."""

    def __init__(self, kernel: Callable, ranks: int, coils: int, maker: factors.Spatial | None = None, blocks: int = 1):
        self.kernel, self.ranks, self.coils, self.maker, self.blocks = kernel, ranks, coils, maker, blocks
        self.made: dict[int, np.ndarray] = {}

    def _spatial(self, row: dict, n: int) -> np.ndarray:
        """The spatial factor of a voxel block, as it is or made of features; that of the last block is kept, as blocks meet others in turn."""
        if "s" in row:
            return _complex(row["s"], n)
        if row["vb"] not in self.made:
            self.made.clear()
            self.made[row["vb"]] = self.maker(row["vb"] // self.blocks, _real(row["feat"], n))
        return self.made[row["vb"]]

    def _columns(self, cells: int, ranks: int, coils: int):
        r = min(self.ranks, ranks)
        c = min(self.coils, coils, max(HELD // (cells * r), 1))
        for a in range(0, ranks, r):
            for b in range(0, coils, c):
                yield slice(a, a + r), slice(b, b + c)

    def signals(self, row: dict, m: int, n: int) -> np.ndarray:
        """Samples by coils: sum over ranks of q times the transform of x conj(s) csm (without maps, x has the coils)."""
        transform, phase = self.kernel(row, m)
        s, q, x = self._spatial(row, n), _complex(row["q"], m), _complex(row["x"], n)
        maps, x = (_complex(row["m"], n), x) if "m" in row else (x, 1.0)
        order, starts, cells = _by_cell(_real(row["cell"], n)[:, 0])
        size, out = int(np.prod(transform.shape)), np.zeros((m, maps.shape[1]), complex)
        weighted, maps = (x * s.conj())[order], maps[order]
        for r, c in self._columns(size, s.shape[1], maps.shape[1]):
            both = weighted[:, r, None] * maps[:, None, c]
            grid = np.zeros((size, both.shape[1] * both.shape[2]), complex)
            grid[cells] = np.add.reduceat(both.reshape(n, -1), starts, axis=0)
            y = transform.forward_many(grid).reshape(m, both.shape[1], both.shape[2])
            out[:, c] += np.einsum("pr,prc->pc", q[:, r], y)
        return out * phase[:, None]

    def images(self, row: dict, m: int, n: int) -> np.ndarray:
        """Voxels by one: sum over ranks and coils of s conj(csm) times the adjoint transform of conj(q) y; without maps, voxels by coils."""
        transform, phase = self.kernel(row, m)
        s, q, y = self._spatial(row, n), _complex(row["q"], m), _complex(row["y"], m)
        maps = _complex(row["m"], n) if "m" in row else None
        cell = _real(row["cell"], n)[:, 0].astype(np.int64)
        size, out = int(np.prod(transform.shape)), np.zeros((n, y.shape[1] if maps is None else 1), complex)
        y = y * phase.conj()[:, None]
        for r, c in self._columns(size, s.shape[1], y.shape[1]):
            both = q[:, r, None].conj() * y[:, None, c]
            z = transform.adjoint_many(both.reshape(m, -1))[cell].reshape(n, both.shape[1], both.shape[2])
            if maps is None:
                out[:, c] += np.einsum("nr,nrc->nc", s[:, r], z)
            else:
                out[:, 0] += np.einsum("nr,nc,nrc->n", s[:, r], maps[:, c].conj(), z, optimize=True)
        return out


def _by_cell(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of voxels by cell, where each cell starts in it, and the cells."""
    order = np.argsort(cell, kind="stable")
    cells, starts = np.unique(cell[order].astype(np.int64), return_index=True)
    return order, starts, cells


def _image_to_image(pair: Pair, coils: int):
    """Cogrouped applyInArrow: voxel blocks and sample blocks of one set, and group of coils -> their part of the image."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        voxels, samples = ([r for batch in t.combine_chunks().to_batches() for r in block_rows(batch)] for t in (left, right))
        part = slice(key[1].as_py() * coils, (key[1].as_py() + 1) * coils)
        ids, coil, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, complex)]
        for v in voxels:
            name = "m" if "m" in v else "x"
            v[name] = np.ascontiguousarray(_complex(v[name], len(v["vs"]) // 8)[:, part]).tobytes()
            v["s"] = pair._spatial(v, len(v["vs"]) // 8).tobytes()
        for s in samples:
            m = len(s["ps"]) // 8
            y = sum((pair.signals(v | s, m, len(v["vs"]) // 8) for v in voxels), np.zeros((m, 1), complex))
            s["y"] = (y * _real(s["w"], m) if "w" in s else y).tobytes()
        for v in voxels:
            n = len(v["vs"]) // 8
            total = sum((pair.images(v | s, len(s["ps"]) // 8, n) for s in samples), np.zeros((n, 1), complex))
            ids.append(np.repeat(np.frombuffer(v["vs"], np.int64), total.shape[1]))
            coil.append(np.tile(np.arange(total.shape[1], dtype=np.int32), n) + (0 if "m" in v else part.start))
            values.append(total.ravel())
        x = np.concatenate(values)
        return pa.table({"v": np.concatenate(ids), "c": np.concatenate(coil).astype(np.int32), "re": x.real.copy(), "im": x.imag.copy()})

    return run


def coil_arrays(df: DataFrame, key: str, coils: int) -> DataFrame:
    """(key, z): re and im of all coils in turn; missing ones are 0."""
    sums = [F.sum(F.when(F.col("c") == c, F.col(x).cast("double")).otherwise(F.lit(0.0))) for c in range(coils) for x in ("re", "im")]
    return df.groupBy(key).agg(F.array(*sums).alias("z"))


def _temporal(spark, p: np.ndarray, place: np.ndarray, q: np.ndarray) -> DataFrame:
    """(p, set, q): the temporal factors as a table."""
    flat = pa.array(np.ascontiguousarray(q).view(float).ravel())
    rows = pa.FixedSizeListArray.from_arrays(flat, 2 * q.shape[1]).cast(pa.list_(pa.float64()))
    return spark.createDataFrame(pa.table({"p": p, "set": place.astype(np.int32), "q": rows}))


def normal_weights(weights: DataFrame | None, samples: DataFrame, coils: int) -> DataFrame | None:
    """(p, w): one weight for each of ``samples`` (p), real, finite, not negative; weights by coil must be the same for all of them."""
    if weights is None:
        return None
    by = "c" in weights.columns
    w = F.col("w").cast("double")
    bad = w.isNull() | F.isnan(w) | (w < 0) | (F.abs(w) == float("inf"))
    rows = samples.select("p").join(weights, "p", "left").groupBy("p").agg(
        F.max(bad).alias("bad"), F.min(w).alias("w"), F.max(w).alias("top"), (F.count_distinct("c") if by else F.lit(coils)).alias("n")
    )
    facts = rows.agg(F.max("bad").alias("bad"), F.max(F.col("w") != F.col("top")).alias("differ"), F.min("n").alias("n")).first()
    if by and weights.select("c").distinct().count() != coils:
        raise ValueError("weights by coil must be given for every coil")
    if facts["bad"] or facts["n"] != coils:
        raise ValueError("weights must be real numbers from 0, one for each sample")
    if facts["differ"]:
        raise ValueError("weights must be the same for all coils")
    return rows.select("p", "w")


def rebuild(old: LowRankOp | None, make: Callable[[], LowRankOp]) -> LowRankOp:
    """Closes ``old`` before a new operator is made, so that both never take space at once."""
    if old is not None:
        old.close()
    return make()


@contextmanager
def phase(spark, name: str):
    """Names the Spark jobs within after ``name``, and any failure too."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    context.setJobDescription(name)
    try:
        yield
    except Exception as e:
        raise RuntimeError(f"{name}: {e}") from e
    finally:
        context.setJobDescription(before)
