"""Explicit encoding: every sample against every voxel, forward, adjoint, derivative and normal.

y[p, c] = n^-1/2 sum_v x[v] csm[v, c] exp(2 pi i (t_p b0_v + sum_l k_lp b_lv))

Samples are (p, t, k array) and voxels (v, b0, b array).  There are two implementations.

``block`` (the default) packs both sides into blocks of numbers, lets every sample block meet every
voxel block by an equi-join, and multiplies matrices: a real product for the phases, one complex
product over all coils.  Sample blocks are the smaller ones, so copies of them go to where the voxel
blocks are (where those are few, samples are dealt to groups, and each group has the voxel blocks).
The pairs are multiplied where they meet: what is shuffled afterwards is sums of outputs, added up
within each task.  With a cache the blocks of phase factors are written once, bucketed by pair, and
stay where they are: the blocks of values come to them.

``sql`` evaluates the phase inside whole-stage code: a voxel table of a proven size goes to every
task, a larger one is cut into parts which every sample meets.

Samples of the same time and coefficients have the same phases, and so have voxels of the same basis
values.  Where there are such copies, either side is one row for each class of them: values of a class
are added up before the product, and each member gets its class's sum after it.  So the products grow with the
pairs of classes, and all else with the rows.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import cplx

#: Bytes of a voxel table that may go to every task of ``sql``.
BROADCAST_BYTES = 64 << 20
#: Voxels of a part where ``sql`` cannot broadcast them.
PART = 50_000
#: Samples and voxels of a block, at most and at least.
SAMPLES, VOXELS, LEAST = 1024, 8192, 64
#: Voxels of a block whose phase factors are cached, at most: a block's factors are one value of a file.
CACHED_VOXELS = 1024
#: Bytes of cached phase factors, at most, unless the caller allows more.
CACHE_BYTES = 8 << 30
#: Classes of equal features are made where there are this many at most for each row.
WORTH = 0.75
#: Bytes of unfinished sums that a task holds.
HELD_BYTES = 64 << 20


def dot(k: str, b: str, n: int) -> Column:
    total = F.col(k)[0] * F.col(b)[0]
    for i in range(1, n):
        total = total + F.col(k)[i] * F.col(b)[i]
    return total


def _facts(df: DataFrame, id_: str, terms: str, features: Column) -> dict:
    """Rows (n), different ids (d), least and greatest number of terms (lo, hi), and about how many features there are (f).

    Ids are counted apart: beside a count of different ids, Spark would keep a sketch for every row.
    """
    size = F.size(terms)
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("lo"), F.max(size).alias("hi"), F.approx_count_distinct(F.xxhash64(features), 0.02).alias("f")).first()
    return facts.asDict() | df.agg(F.countDistinct(id_).alias("d")).first().asDict()


class Classes:
    """The rows of a table by their features: ``rows`` (id, f), one for each class of equal f, and ``members`` (id, rep).

    ``rep`` is the least id of a class; ``members`` is None where copies are too few to be worth it, and every row is a class.
    """

    def __init__(self, df: DataFrame, id_: str, features: Column, count: int, distinct: int):
        rows = df.select(F.col(id_).cast("long").alias(id_), features.alias("f"))
        self.id, self.rows, self.members, self.count = id_, rows, None, count
        if distinct <= WORTH * count:
            self.rows = shared.cut(rows.groupBy("f").agg(F.min(id_).alias(id_)).select(id_, "f"))
            self.members = shared.cut(rows.join(self.rows.withColumnRenamed(id_, "rep"), "f").select(id_, "rep"))
            self.count = self.rows.count()

    def of(self, values: DataFrame) -> DataFrame:
        """Values by id as values by class, not yet added up."""
        return values if self.members is None else values.join(self.members, self.id).drop(self.id).withColumnRenamed("rep", self.id)

    def each(self, values: DataFrame) -> DataFrame:
        """Values by class as values of every member."""
        return values if self.members is None else values.withColumnRenamed(self.id, "rep").join(self.members, "rep").drop("rep")


def meet(samples: DataFrame, voxels: DataFrame, count: int, row_bytes: int) -> DataFrame:
    """Every sample beside every voxel (``count`` of them, of ``row_bytes`` each)."""
    # Samples are the smaller table: as they lie in a file, one task would have them all.
    samples = samples.repartition(4 * samples.sparkSession.sparkContext.defaultParallelism, "p")
    if count * row_bytes <= BROADCAST_BYTES:
        return samples.crossJoin(F.broadcast(voxels))
    parts = -(-count // PART)
    left = samples.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = voxels.withColumn("_part", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int"))
    return left.join(right, "_part").drop("_part")


# ---------------------------------------------------------------- blocks


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """A column of equally long lists of doubles as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1)


def _packer(id_: str, block: str, matrices: tuple[str, ...]) -> Callable[[pa.Table], pa.Table]:
    """applyInArrow: the rows of a block -> one row with their ids and matrices as bytes, by id."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(id_)
        ids = table.column(id_).to_numpy().astype(np.int64)
        out = {block: table.column(block).slice(0, 1).combine_chunks(), f"{id_}s": pa.array([ids.tobytes()], pa.binary())}
        for name in matrices:
            out[name] = pa.array([_matrix(table.column(name), len(ids)).tobytes()], pa.binary())
        return pa.table(out)

    return run


def packed(df: DataFrame, id_: str, matrices: dict[str, Column], block: Column, name: str) -> DataFrame:
    """``df`` in one row for each ``block``: (name, ids, one binary of doubles for each of ``matrices``, arrays of doubles), by id."""
    rows = df.select(block.cast("int").alias(name), F.col(id_).cast("long").alias(id_), *[c.cast("array<double>").alias(n) for n, c in matrices.items()])
    schema = f"{name} int, {id_}s binary, " + ", ".join(f"{n} binary" for n in matrices)
    return rows.groupBy(name).applyInArrow(_packer(id_, name, tuple(matrices)), schema)


def dealt(id_: str, blocks: int) -> Column:
    """The number of the block, of ``blocks``, that a row goes to."""
    return F.pmod(F.xxhash64(F.col(id_).cast("long")), F.lit(blocks)).cast("int")


def phase_factors(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """exp(2 pi i f g^T) of features by samples and by voxels."""
    phase = f @ g.T
    phase -= np.rint(phase)
    phase *= 2 * np.pi
    out = np.empty(phase.shape, complex)
    np.cos(phase, out=out.real)
    np.sin(phase, out=out.imag)
    return out


def _complex(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, complex).reshape(rows, -1)


def _real(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(rows, -1)


def _long(keys: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    """A matrix of ids by coils as rows (id, c, re, im)."""
    n, m = total.shape
    flat = total.ravel()
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(keys, m)), pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(flat.real.copy()), pa.array(flat.imag.copy())],
        names=["id", "c", "re", "im"],
    )


def _sums(out: str, ids: str, product: Callable[[dict, int, int], np.ndarray]):
    """mapInArrow over pairs of blocks: (id, c, re, im), summed over the pairs of each output block that a task meets.

    Sums of HELD_BYTES at most wait for further pairs; beyond that the one that waited longest is handed on.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = 0
        for batch in batches:
            for row in block_rows(batch):
                at, value = row[out], product(row, len(row["ps"]) // 8, len(row["vs"]) // 8)
                keys, total = held.pop(at, (None, None))
                if keys is None:
                    keys, total = np.frombuffer(row[ids], np.int64).copy(), np.zeros_like(value)
                    size += total.nbytes
                total += value
                held[at] = keys, total
                while size > HELD_BYTES and len(held) > 1:
                    oldest = held.pop(next(iter(held)))
                    size -= oldest[1].nbytes
                    yield _long(*oldest)
        for part in held.values():
            yield _long(*part)

    return run


def block_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch as dicts; binaries are not copied."""
    columns = {n: batch.column(n) for n in batch.schema.names}
    for i in range(batch.num_rows):
        yield {n: c[i].as_buffer() if pa.types.is_binary(c.type) and c[i].is_valid else c[i].as_py() for n, c in columns.items()}


def _factors(row: dict, m: int, n: int) -> np.ndarray:
    if row.get("phase") is not None:
        return _complex(row["phase"], m)
    return phase_factors(_real(row["f"], m), _real(row["g"], n))


def _derivative(row: dict, m: int, n: int) -> np.ndarray:
    rate = _real(row["fd"], m) @ _real(row["g"], n)[:, 1:].T
    return _factors(row, m, n) * (2j * np.pi * rate)


def _by_term(row: dict, m: int, n: int) -> np.ndarray:
    """Samples by terms and coils: the product for values times each basis function."""
    z = _complex(row["z"], n)
    return _factors(row, m, n) @ (_real(row["g"], n)[:, 1:, None] * z[:, None, :]).reshape(n, -1)


def _named(rows: DataFrame, first: str, others: str) -> DataFrame:
    """Rows of classes with their features by name again."""
    return rows.withColumns({first: F.col("f")[0], others: F.expr("slice(f, 2, size(f) - 1)")}).drop("f")


class ExplicitOp:
    """The operator of samples (p, t, k) on voxels (v, b0, b), optionally with coil maps (v, c, re, im).

    ``k`` and ``b`` hold ``n_terms`` numbers; ``k_dot`` in samples gives the derivative of ``k``.
    Voxels are the masked ones only; their number fixes the normalisation.  ``blocks`` gives the
    numbers of sample and voxel blocks (default: by their counts and the cores at hand).
    ``cache=True`` writes all phase factors to the shared folder (16 bytes for each sample and voxel, at most ``cache_bytes``).
    """

    def __init__(self, samples: DataFrame, voxels: DataFrame, n_terms: int, csm: DataFrame | None = None, implementation: str = "block",
                 blocks: tuple[int, int] | None = None, cache: bool = False, cache_bytes: int = CACHE_BYTES):
        if n_terms not in (9, 13, 16, 20):
            raise ValueError(f"{n_terms} terms")
        if implementation not in ("block", "sql"):
            raise ValueError(f"unknown implementation: {implementation}")
        if cache and implementation != "block":
            raise ValueError("only blocks can be cached")
        self.samples, self.voxels, self.n, self.csm, self.implementation = samples, voxels, n_terms, csm, implementation
        f, g = (F.concat(F.array(F.col(a).cast("double")), F.slice(F.col(b).cast("array<double>"), 1, n_terms)) for a, b in (("t", "k"), ("b0", "b")))
        sizes, rows = _facts(voxels, "v", "b", g), _facts(samples, "p", "k", f)
        self.count, self.sample_count = sizes["n"], rows["n"]
        if not self.count or not self.sample_count:
            raise ValueError("no voxels" if not self.count else "no samples")
        if sizes["d"] != sizes["n"] or rows["d"] != rows["n"]:
            raise ValueError("voxels and samples must be numbered uniquely")
        for what, facts in (("voxels", sizes), ("samples", rows)):
            if facts["lo"] != facts["hi"] or facts["lo"] < n_terms:
                raise ValueError(f"{what} must have {n_terms} terms")
        self.coils = coil_count(csm)
        self._s = Classes(samples, "p", f, self.sample_count, rows["f"])
        self._v = Classes(voxels, "v", g, self.count, sizes["f"])
        self._maps: DataFrame | None = None
        self._cached: shared.Bucketed | None = None
        self._blocks = blocks or self._default_blocks(CACHED_VOXELS if cache else VOXELS)
        if min(self._blocks) < 1:
            raise ValueError("there must be a block at least")
        # Where voxel blocks are few, samples are dealt to groups, each with copies of the voxel blocks.
        self._deals = min(-(-2 * self._cores() // self._blocks[1]), self._blocks[0])
        if cache:
            need = 16 * self._v.count * self._s.count
            if need > cache_bytes:
                raise ValueError(f"the phase factors take {need} bytes; {cache_bytes} are allowed")
            self._write_cache()

    def _cores(self) -> int:
        return self.voxels.sparkSession.sparkContext.defaultParallelism

    def _default_blocks(self, voxels: int) -> tuple[int, int]:
        cores = self._cores()
        size = lambda n, most: max(min(-(-n // (4 * cores)), most), min(LEAST, n))
        return -(-self._s.count // SAMPLES), -(-self._v.count // size(self._v.count, voxels))

    def _write_cache(self) -> None:
        """Writes all phase factors as a table bucketed by pair, to which products bring their values."""
        pairs = self._pairs(self._sample_blocks(), self._voxel_blocks()).withColumn("pair", self._pair())
        self._cached = shared.Bucketed(pairs, "pair", lambda df: df.mapInArrow(_phases, PHASES))

    def _pair(self) -> Column:
        return F.col("sb").cast("long") * self._blocks[1] + F.col("vb")

    @property
    def shape(self) -> tuple[int, int]:
        """Rows (samples by coils) and columns (voxels)."""
        return self.sample_count * self.coils, self.count

    @property
    def H(self) -> Adjoint:  # noqa: N802
        return Adjoint(self)

    def close(self) -> None:
        """Deletes the cached phase factors; products made from now on still work, those not yet run do not."""
        if self._cached is not None:
            self._cached.drop()
            self._cached = None

    def phase(self) -> Column:
        return F.col("t") * F.col("b0") + dot("k", "b", self.n)

    # ---- blocks

    def _sample_blocks(self, **more: Column) -> DataFrame:
        return packed(self._s.rows if not more else more.pop("of"), "p", {"f": F.col("f"), **more}, dealt("p", self._blocks[0]), "sb")

    def _voxel_blocks(self, **more: Column) -> DataFrame:
        return packed(self._v.rows if not more else more.pop("of"), "v", {"g": F.col("f"), **more}, dealt("v", self._blocks[1]), "vb")

    def _pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Every sample block beside every voxel block."""
        left = left.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(self._blocks[1] - 1)))).withColumn("deal", F.col("sb") % self._deals)
        right = right.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(self._deals - 1))))
        return left.join(right.hint("merge"), ["vb", "deal"])

    def _product(self, left: DataFrame, right: DataFrame, out: str, ids: str, product) -> DataFrame:
        if self._cached is None:
            pairs = self._pairs(left, right)
        else:
            # The blocks of values, for each pair, meet the factors in the buckets those lie in.
            one, other = ("vb", "sb") if out == "sb" else ("sb", "vb")
            values = (right if out == "sb" else left).select(one, "z")
            n = self._blocks[0] if other == "sb" else self._blocks[1]
            values = values.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(self._pair().alias("pair"), "z")
            pairs = self._cached.read().join(values.hint("shuffle_hash"), "pair")
        rows = pairs.mapInArrow(_sums(out, ids, product), "id long, c int, re double, im double")
        scale = self.count**-0.5
        return rows.groupBy("id", "c").agg((F.sum("re") * scale).alias("re"), (F.sum("im") * scale).alias("im"))

    def _coil_arrays(self, df: DataFrame, key: str, re: str, im: str) -> DataFrame:
        """(key, z): re and im of all coils in turn; missing ones are 0."""
        sums = [F.sum(F.when(F.col("c") == c, F.col(x)).otherwise(F.lit(0.0))) for c in range(self.coils) for x in (re, im)]
        return df.groupBy(key).agg(F.array(*sums).alias("z"))

    def _uncached(self) -> ExplicitOp:
        op = copy.copy(self)
        op._cached = None
        return op

    def _filled(self, rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
        """``rows`` with their z of ``values``, or zeros: blocks of values have all rows of a block, as those of factors do."""
        zeros = F.array(*[F.lit(0.0)] * (2 * self.coils))
        return rows.join(values, key, "left").withColumn("z", F.coalesce("z", zeros))

    # ---- products

    def _coil_maps(self) -> DataFrame:
        """(v, rep, m): the maps of a voxel, re and im of all coils in turn, beside its class; written once."""
        if self._maps is None:
            whole = F.col("re").isNotNull() & F.col("im").isNotNull()
            maps = self._coil_arrays(self.csm.select("v", "c", *[F.when(whole, F.col(x)).alias(x) for x in ("re", "im")]), "v", "re", "im").withColumnRenamed("z", "m")
            members = self._v.rows.select("v", F.col("v").alias("rep")) if self._v.members is None else self._v.members
            self._maps = shared.cut(members.join(maps, "v"))
        return self._maps

    def _class_values(self, image: DataFrame) -> DataFrame:
        """(v, z): the sums, by class, of x * csm for all coils in turn."""
        if self.csm is None:
            return self._coil_arrays(self._v.of(self._weighted(image).select("v", "c", "zr", "zi")), "v", "zr", "zi")
        z = self._coil_maps().join(image.select("v", F.col("re").alias("xr"), F.col("im").alias("xi")), "v")
        parts = [cplx.mul((F.col("xr"), F.col("xi")), (F.col("m")[2 * c], F.col("m")[2 * c + 1])) for c in range(self.coils)]
        return z.groupBy(F.col("rep").alias("v")).agg(F.array(*[F.coalesce(F.sum(x), F.lit(0.0)) for pair in parts for x in pair]).alias("z"))

    def _weighted(self, image: DataFrame) -> DataFrame:
        """Voxels with x * csm as (zr, zi) for each coil c."""
        z = self.voxels.join(image.select("v", F.col("re").alias("xr"), F.col("im").alias("xi")), "v")
        if self.csm is None:
            return z.withColumns({"c": F.lit(0), "zr": F.col("xr"), "zi": F.col("xi")})
        z = z.join(self.csm.select("v", "c", F.col("re").alias("cr"), F.col("im").alias("ci")), "v")
        re, im = cplx.mul((F.col("xr"), F.col("xi")), (F.col("cr"), F.col("ci")))
        return z.withColumns({"zr": re, "zi": im})

    def forward(self, image: DataFrame, derivative: bool = False) -> DataFrame:
        """Signal (p, c, re, im) of an image (v, re, im); ``derivative`` multiplies by 2 pi i k_dot . b."""
        if self.implementation == "block":
            z = self._class_values(image)
            right = self._voxel_blocks(of=self._filled(self._v.rows, z, "v"), z=F.col("z"))
            if derivative:
                return self._slopes(right)
            return self._s.each(self._product(self._sample_blocks(), right, "sb", "ps", lambda row, m, n: _factors(row, m, n) @ _complex(row["z"], n)).withColumnRenamed("id", "p"))
        z = self._v.of(self._weighted(image).select("v", "c", "zr", "zi")).groupBy("v", "c").agg(F.sum("zr").alias("zr"), F.sum("zi").alias("zi"))
        z = _named(self._v.rows, "b0", "b").join(z.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("c", "zr", "zi"))).alias("z")), "v")
        samples = self.samples if derivative else _named(self._s.rows, "t", "k")  # members of a class may differ in k_dot
        both = meet(samples, z, self._v.count, 64 + 8 * self.n + 48 * self.coils).withColumn("_phase", self.phase())
        er, ei = cplx.cis(F.col("_phase"))
        both = both.withColumns({"_er": er, "_ei": ei})
        if derivative:
            rate = dot("k_dot", "b", self.n) * (2 * 3.141592653589793)
            both = both.withColumn("_rate", rate).withColumns({"_er": -F.col("_ei") * F.col("_rate"), "_ei": F.col("_er") * F.col("_rate")})
        coil = both.select("p", "_er", "_ei", F.explode("z").alias("z"))
        re, im = cplx.mul((F.col("z.zr"), F.col("z.zi")), (F.col("_er"), F.col("_ei")))
        scale = self.count**-0.5
        out = coil.groupBy("p", F.col("z.c").alias("c")).agg((F.sum(re) * scale).alias("re"), (F.sum(im) * scale).alias("im"))
        return out if derivative else self._s.each(out)

    def _slopes(self, right: DataFrame) -> DataFrame:
        """The derivative of the signal, from blocks of voxels with their values; the cache has no derivatives."""
        op, n, coils = self._uncached(), self.n, self.coils
        rate = F.slice(F.col("k_dot").cast("array<double>"), 1, n)
        if self._s.members is None:
            left = self._sample_blocks(of=self._s.rows.join(self.samples.select("p", rate.alias("fd")), "p"), fd=F.col("fd"))
            return op._product(left, right, "sb", "ps", lambda row, m, n: _derivative(row, m, n) @ _complex(row["z"], n)).withColumnRenamed("id", "p")
        # The derivative is linear in k_dot, in which members differ: a class has one product for each term.
        parts = op._product(self._sample_blocks(), right, "sb", "ps", _by_term).withColumnRenamed("id", "p")
        term = F.floor(F.col("c") / coils)
        sums = [F.array(*[F.sum(F.when(term == i, F.col(x))) for i in range(n)]).alias(x) for x in ("re", "im")]
        parts = self._s.each(parts.groupBy("p", (F.col("c") % coils).cast("int").alias("c")).agg(*sums)).join(self.samples.select("p", rate.alias("fd")), "p")
        return parts.select("p", "c", (dot("im", "fd", n) * (-2 * np.pi)).alias("re"), (dot("re", "fd", n) * (2 * np.pi)).alias("im"))

    def adjoint(self, signal: DataFrame, grid: DataFrame | None = None) -> DataFrame:
        """Image (v, re, im) of a signal (p, c, re, im); on ``grid`` (v) voxels outside are 0."""
        if self.implementation == "block":
            signal = self._coil_arrays(self._s.of(signal.select("p", "c", "re", "im")), "p", "re", "im")
            left = self._sample_blocks(of=self._filled(self._s.rows, signal, "p"), z=F.col("z"))
            sums = self._product(left, self._voxel_blocks(), "vb", "vs", lambda row, m, n: _factors(row, m, n).conj().T @ _complex(row["z"], m))
            sums, scale = sums.withColumnRenamed("id", "v"), 1.0
        else:
            sums, scale = self._adjoint_sums(signal), self.count**-0.5
        if self.csm is not None and self.implementation == "block":
            # Few classes have many members: their sums of all coils come to the maps.
            sums = self._coil_maps().join(self._coil_arrays(sums, "v", "re", "im").withColumnRenamed("v", "rep"), "rep")
            parts = [cplx.mul((F.col("z")[2 * c], F.col("z")[2 * c + 1]), (F.col("m")[2 * c], -F.col("m")[2 * c + 1])) for c in range(self.coils)]
            re, im = (sum((pair[i] for pair in parts[1:]), parts[0][i]) for i in (0, 1))
            sums = sums.select("v", re.alias("re"), im.alias("im"))
        else:
            sums = self._v.each(sums)
        if self.csm is not None and self.implementation == "sql":
            sums = sums.join(self.csm.select("v", "c", F.col("re").alias("cr"), F.col("im").alias("ci")), ["v", "c"])
            re, im = cplx.mul((F.col("re"), F.col("im")), (F.col("cr"), -F.col("ci")))
            sums = sums.groupBy("v").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
        out = sums.select("v", (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))
        if grid is None:
            return out
        zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
        return grid.select("v").join(out, "v", "left").select("v", zero("re"), zero("im"))

    def _adjoint_sums(self, signal: DataFrame) -> DataFrame:
        y = self._s.of(signal.select("p", "c", "re", "im")).groupBy("p", "c").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        y = y.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("c", "re", "im"))).alias("y"))
        samples, voxels = _named(self._s.rows, "t", "k").join(y, "p"), _named(self._v.rows, "b0", "b")
        both = meet(samples, voxels, self._v.count, 64 + 8 * self.n).withColumn("_phase", self.phase())
        er, ei = cplx.cis(F.col("_phase"))
        both = both.withColumns({"_er": er, "_ei": -ei}).select("v", "_er", "_ei", F.explode("y").alias("y"))
        re, im = cplx.mul((F.col("y.re"), F.col("y.im")), (F.col("_er"), F.col("_ei")))
        return both.groupBy("v", F.col("y.c").alias("c")).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))

    def normal(self, image: DataFrame, weights: DataFrame | None = None) -> DataFrame:
        """A^H D A x; ``weights`` (p[, c], w) are real and not negative, without them D is 1."""
        y = self.forward(image)
        if weights is not None:
            if not weights.where("w is null or isnan(w) or w < 0").isEmpty():
                raise ValueError("weights must be real numbers from 0")
            keys = [c for c in ("p", "c") if c in weights.columns]
            y = y.join(weights.select(*keys, "w"), keys).select("p", "c", (F.col("re") * F.col("w")).alias("re"), (F.col("im") * F.col("w")).alias("im"))
        return self.adjoint(y)

    def mul(self, image: DataFrame, out: DataFrame | None = None, alpha: complex = 1.0, beta: complex = 0.0) -> DataFrame:
        """alpha A x + beta out."""
        return axpby(self.forward(image), out, ["p", "c"], alpha, beta)


#: Voxels that may go to every block of samples.
NEAR = 1024


class NearOp:
    """The operator of samples (p, t, k[, k_dot][, y][, w]) on a few voxels (v, b0, b), at most NEAR, optionally with coil maps.

    The voxels are one block that goes to all samples; these are packed into blocks where they lie, which are written once (``keep``), and
    products read them: only sums by voxel are shuffled.  ``y`` is the samples' signal, re and im of all coils in turn,
    ``w`` real weights from 0 of its squares; p must be unique, which is not looked at here.
    """

    def __init__(self, samples: DataFrame, voxels: DataFrame, n_terms: int, csm: DataFrame | None = None, keep: bool = True):
        if n_terms not in (9, 13, 16, 20):
            raise ValueError(f"{n_terms} terms")
        g = F.concat(F.array(F.col("b0").cast("double")), F.slice(F.col("b").cast("array<double>"), 1, n_terms))
        facts = _facts(voxels, "v", "b", g)
        self.voxels, self.csm, self.count, self._g = voxels, csm, facts["n"], g
        if not self.count or self.count > NEAR:
            raise ValueError("no voxels" if not self.count else f"more than {NEAR} voxels")
        if facts["d"] != self.count or facts["lo"] != facts["hi"] or facts["lo"] < n_terms:
            raise ValueError(f"voxels must be numbered uniquely and have {n_terms} terms")
        self.coils = coil_count(csm)
        terms = lambda c: F.slice(F.col(c).cast("array<double>"), 1, n_terms)
        more = {"fd": ("k_dot", terms), "y": ("y", F.col), "w": ("w", F.array)}
        columns = {"f": F.concat(F.array(F.col("t").cast("double")), terms("k"))} | {n: make(c) for n, (c, make) in more.items() if c in samples.columns}
        rows = samples.select(F.col("p").cast("long").alias("p"), *[c.cast("array<double>").alias(n) for n, c in columns.items()])
        self._kept, self._blocks = None, rows.mapInArrow(_blocks_of(tuple(columns)), "ps binary, " + ", ".join(f"{n} binary" for n in columns))
        if keep:
            self._kept = shared.Stored(self._blocks)
            self._blocks = self._kept.read()

    def close(self) -> None:
        """Deletes the written blocks; the operator and its products become invalid."""
        if self._kept is not None:
            self._kept.drop()

    def _beside(self, image: DataFrame | None, drop: tuple[str, ...]) -> DataFrame:
        """Blocks of samples beside the block of all voxels, with their values for all coils if there is an image."""
        rows, columns = self.voxels.select("v", self._g.alias("g")), {"g": F.col("g")}
        if image is not None:
            parts = image.select("v", F.lit(0).alias("c"), "re", "im")
            if self.csm is not None:
                re, im = cplx.mul((F.col("re"), F.col("im")), (F.col("cr"), F.col("ci")))
                parts = parts.drop("c").join(self.csm.select("v", "c", F.col("re").alias("cr"), F.col("im").alias("ci")), "v").select("v", "c", re.alias("re"), im.alias("im"))
            sums = [F.coalesce(F.sum(F.when(F.col("c") == c, F.col(x))), F.lit(0.0)) for c in range(self.coils) for x in ("re", "im")]
            rows = rows.join(parts.groupBy("v").agg(F.array(*sums).alias("z")), "v", "left")
            columns["z"] = F.coalesce("z", F.array(*[F.lit(0.0)] * (2 * self.coils)))
        block = packed(rows, "v", columns, F.lit(0), "vb")
        return self._blocks.drop(*drop).crossJoin(F.broadcast(block))

    def _image(self, pairs: DataFrame, product: Callable[[dict, int, int], np.ndarray], scale: float) -> DataFrame:
        """The sums by voxel and coil of a product of all blocks, times the maps: an image."""
        rows = pairs.mapInArrow(_sums("vb", "vs", product), "id long, c int, re double, im double")
        sums = rows.groupBy(F.col("id").alias("v"), "c").agg((F.sum("re") * scale).alias("re"), (F.sum("im") * scale).alias("im"))
        if self.csm is None:
            return sums.select("v", "re", "im")
        sums = sums.join(self.csm.select("v", "c", F.col("re").alias("cr"), F.col("im").alias("ci")), ["v", "c"])
        re, im = cplx.mul((F.col("re"), F.col("im")), (F.col("cr"), -F.col("ci")))
        return sums.groupBy("v").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))

    def forward(self, image: DataFrame) -> DataFrame:
        """Signal (p, c, re, im) of an image (v, re, im)."""
        scale = self.count**-0.5

        def run(batches):
            for batch in batches:
                for row in block_rows(batch):
                    m, n = len(row["ps"]) // 8, len(row["vs"]) // 8
                    yield _long(np.frombuffer(row["ps"], np.int64), _factors(row, m, n) @ _complex(row["z"], n) * scale)

        rows = self._beside(image, ("fd", "y", "w")).mapInArrow(run, "id long, c int, re double, im double")
        return rows.withColumnRenamed("id", "p")

    def adjoint(self, signal: None = None, grid: DataFrame | None = None) -> DataFrame:
        """Image (v, re, im) of the samples' own signal, weighted; all voxels have a value."""
        if signal is not None:
            raise ValueError("samples have their own signal")
        weigh = _weigh("w" in self._blocks.columns)
        product = lambda row, m, n: _factors(row, m, n).conj().T @ weigh(row, _complex(row["y"], m))
        return self._image(self._beside(None, ("fd",)), product, self.count**-0.5)

    def normal(self, image: DataFrame, weights: None = None) -> DataFrame:
        """A^H D A x with the samples' own weights D: each block goes from image to image."""
        if weights is not None:
            raise ValueError("samples have their own weights")
        weigh = _weigh("w" in self._blocks.columns)

        def product(row: dict, m: int, n: int) -> np.ndarray:
            e = _factors(row, m, n)
            return e.conj().T @ weigh(row, e @ _complex(row["z"], n))

        return self._image(self._beside(image, ("fd", "y")), product, 1 / self.count)

    def delay_step(self, image: DataFrame, factor: float) -> float:
        """As ``delay_step``, of what the image leaves of the samples' own signal."""
        scale = self.count**-0.5

        def run(batches):
            dotted = norm = 0.0
            for batch in batches:
                for row in block_rows(batch):
                    m, n = len(row["ps"]) // 8, len(row["vs"]) // 8
                    row["phase"], z = _factors(row, m, n), _complex(row["z"], n)
                    residual, slope = _complex(row["y"], m) - row["phase"] @ z * scale, _slope(row, m, n) @ z * scale
                    dotted += float(np.vdot(slope, residual).real)
                    norm += float(np.vdot(slope, slope).real)
            yield pa.RecordBatch.from_arrays([pa.array([dotted]), pa.array([norm])], names=["dotted", "norm"])

        sums = self._beside(image, ("w",)).mapInArrow(run, "dotted double, norm double")
        return sums.agg((F.sum("dotted") / F.sum("norm") * factor).alias("delta")).first()["delta"]


def coil_count(csm: DataFrame | None) -> int:
    return 1 if csm is None else csm.agg(F.max("c").alias("c")).first()["c"] + 1


def _slope(row: dict, m: int, n: int) -> np.ndarray:
    return row["phase"] * (2j * np.pi * (_real(row["fd"], m) @ _real(row["g"], n)[:, 1:].T))


def _weigh(own: bool) -> Callable[[dict, np.ndarray], np.ndarray]:
    return (lambda row, y: y * _real(row["w"], len(y))) if own else lambda row, y: y


def _blocks_of(matrices: tuple[str, ...]):
    """mapInArrow: rows (p, lists of doubles) -> blocks of at most SAMPLES rows that lie together, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, SAMPLES):
                rows = batch.slice(at, SAMPLES)
                values = [rows.column("p").to_numpy().astype(np.int64), *[_matrix(rows.column(n), rows.num_rows) for n in matrices]]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in values], names=["ps", *matrices])

    return run


class Adjoint:
    """The adjoint of an operator as an operator; its own adjoint is the operator."""

    def __init__(self, of: ExplicitOp):
        self.H = of

    @property
    def shape(self) -> tuple[int, int]:
        return self.H.shape[::-1]

    def forward(self, signal: DataFrame) -> DataFrame:
        return self.H.adjoint(signal)

    def adjoint(self, image: DataFrame) -> DataFrame:
        return self.H.forward(image)

    def mul(self, signal: DataFrame, out: DataFrame | None = None, alpha: complex = 1.0, beta: complex = 0.0) -> DataFrame:
        return axpby(self.forward(signal), out, ["v"], alpha, beta)


def axpby(x: DataFrame, y: DataFrame | None, keys: list[str], alpha: complex, beta: complex) -> DataFrame:
    """alpha x + beta y of complex tables (keys, re, im); what one lacks is 0 there."""
    scaled = lambda df, s: df.select(*keys, *[c.alias(n) for c, n in zip(cplx.mul((F.col("re"), F.col("im")), (F.lit(complex(s).real), F.lit(complex(s).imag))), ("re", "im"), strict=True)])
    both = scaled(x, alpha) if y is None or beta == 0 else scaled(x, alpha).unionByName(scaled(y, beta))
    return both.groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


PHASES = "pair long, sb int, vb int, ps binary, vs binary, phase binary"


def _phases(batches: Iterator[pa.RecordBatch]):
    """mapInArrow: pairs of blocks -> their phase factors."""
    kinds = {"pair": pa.int64(), "sb": pa.int32(), "vb": pa.int32(), "ps": pa.binary(), "vs": pa.binary()}
    for batch in batches:
        for row in block_rows(batch):
            phase = phase_factors(_real(row["f"], len(row["ps"]) // 8), _real(row["g"], len(row["vs"]) // 8))
            own = [pa.array([row[n] if k != pa.binary() else row[n].to_pybytes()], k) for n, k in kinds.items()]
            yield pa.RecordBatch.from_arrays([*own, pa.array([phase.tobytes()], pa.binary())], names=[*kinds, "phase"])


def delay_step(residual: DataFrame, slope: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """factor * Re(<b, r> / <b, b>) of residual r and derivative signal b, both (keys, re, im)."""
    both = residual.join(slope.select(*keys, F.col("re").alias("br"), F.col("im").alias("bi")), keys)
    dotted = F.sum(F.col("br") * F.col("re") + F.col("bi") * F.col("im"))
    return both.agg((dotted / F.sum(F.col("br") * F.col("br") + F.col("bi") * F.col("bi")) * factor).alias("delta"))


def demodulate(df: DataFrame, measured: Column, nominal: Column) -> DataFrame:
    """(re, im) divided by exp(2 pi i measured) and multiplied by exp(-2 pi i nominal)."""
    er, ei = cplx.cis(-(measured + nominal))
    re, im = cplx.mul((F.col("re"), F.col("im")), (er, ei))
    return df.withColumns({"_re": re, "_im": im}).drop("re", "im").withColumnsRenamed({"_re": "re", "_im": "im"})
