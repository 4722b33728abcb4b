"""A Spark data source of MAT-files of version 5: the numeric variables of an acquisition as rows.

The driver hops over the tags of a file's elements and reads no values.  A variable that is stored
plainly is cut into ranges of cells, each a task that reads its own bytes; one that is compressed is a
task, which inflates it as it streams past, twice side by side where it is complex.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .volumes import BATCH, PIECE, opened

FORMAT = "fieldweave_mat"
SCHEMA = "name string, cell long, dims array<long>, re double, im double"
# The types of elements, and the classes of arrays that hold numbers.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
NUMERIC = range(6, 16)
COMPLEX = 0x800
#: Cells of a plainly stored variable that one task reads, and bytes before the values of a compressed one, at most.
CELLS, HEAD = 1 << 20, 1 << 16


@dataclass
class Part(InputPartition):
    """Cells first..last - 1 of a variable: where each part's numbers start (im -1: none), in the file or in the inflated element."""

    name: str
    dims: tuple[int, ...]
    order: str
    kinds: tuple[str, str]
    starts: tuple[int, int]
    first: int
    last: int
    packed: tuple[int, int] | None


def _tag(data: bytes, at: int, order: str) -> tuple[int, int, int, int]:
    """(type, bytes, where the data start, where the next element starts) of the element at ``at``."""
    kind, size = struct.unpack_from(order + "II", data, at)
    if kind >> 16:  # a small element holds its data in its tag
        return kind & 0xFFFF, kind >> 16, at + 4, at + 8
    return kind, size, at + 8, at + 8 + -(-size // 8) * 8


def _described(data: bytes, order: str):
    """(name, dims, kinds, starts) of a numeric array whose element's data begin ``data``; None for other arrays."""
    _, _, start, at = _tag(data, 0, order)
    flags = struct.unpack_from(order + "I", data, start)[0]
    _, size, start, at = _tag(data, at, order)
    dims = struct.unpack_from(f"{order}{size // 4}i", data, start)
    _, size, start, at = _tag(data, at, order)
    name = data[start : start + size].decode("utf-8", "replace")
    if flags & 0xFF not in NUMERIC:
        return None
    if not math.prod(dims):
        return name, dims, ("f8", "f8"), (0, -1)
    kind, size, start, at = _tag(data, at, order)
    kinds, starts = [TYPES[kind]], [start]
    if flags & COMPLEX:
        kinds.append(at)  # the imaginary part's own tag lies there
        starts.append(at)
    return name, dims, tuple(kinds), tuple(starts)


class MatReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.wanted, self.cells = options["path"], options.get("variable"), int(options.get("cells", CELLS))

    def partitions(self) -> list[Part]:
        system, name = opened(self.path)
        out: list[Part] = []
        with system.open_input_file(name) as file:
            head = file.read(128)
            order = {b"IM": "<", b"MI": ">"}.get(head[126:128])
            if len(head) < 128 or order is None or struct.unpack_from(order + "H", head, 124)[0] != 0x0100:
                raise ValueError("not a MAT-file of version 5")
            at, end = 128, file.size()
            while at + 8 <= end:
                file.seek(at)
                kind, size = struct.unpack(order + "II", file.read(8))
                if at + 8 + size > end:
                    raise ValueError(f"{self.path} ends within an element")
                if kind == COMPRESSED:
                    out += self._compressed(file, at + 8, size, order)
                elif kind == MATRIX:
                    out += self._plain(file, at + 8, size, order)
                at += 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)
        return out

    def _plain(self, file, at: int, size: int, order: str) -> list[Part]:
        file.seek(at)
        found = _described(file.read(min(size, HEAD)), order)
        if found is None or self.wanted not in (None, found[0]):
            return []
        name, dims, kinds, starts = found
        if len(starts) == 2 and starts[1] >= 0:
            file.seek(at + starts[1])
            kind, _, start, _ = _tag(file.read(16), 0, order)
            kinds, starts = (kinds[0], TYPES[kind]), (starts[0], starts[1] + start)
        starts = (at + starts[0], at + starts[1] if len(starts) == 2 and starts[1] >= 0 else -1)
        kinds, n = (kinds[0], kinds[-1] if isinstance(kinds[-1], str) else "f8"), math.prod(dims)
        return [Part(name, dims, order, kinds, starts, a, min(a + self.cells, n), None) for a in range(0, n, self.cells)]

    def _compressed(self, file, at: int, size: int, order: str) -> list[Part]:
        file.seek(at)
        data = zlib.decompressobj().decompress(file.read(min(size, HEAD)), HEAD)
        if _tag(data, 0, order)[0] != MATRIX:
            return []
        found = _described(data[8:], order)
        if found is None or self.wanted not in (None, found[0]) or not math.prod(found[1]):
            return []
        name, dims, kinds, starts = found
        # The tag of the imaginary part is read where it is met.
        whole = (starts[0] + 8, starts[1] + 8 if len(starts) == 2 else -1)
        return [Part(name, dims, order, (kinds[0], ""), whole, 0, math.prod(dims), (at, size))]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, name = opened(self.path)
        with system.open_input_file(name) as one, system.open_input_file(name) as two:
            re = _numbers(one, part, 0)
            im = _numbers(two, part, 1) if part.starts[1] >= 0 else None
            for at in range(part.first, part.last, BATCH):
                n = min(BATCH, part.last - at)
                x = re(n)
                y = im(n) if im else np.zeros(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.name] * n), pa.array(np.arange(at, at + n)), pa.array([list(part.dims)] * n, pa.list_(pa.int64())), pa.array(x), pa.array(y)],
                    names=["name", "cell", "dims", "re", "im"],
                )


def _numbers(file, part: Part, side: int):
    """A function that gives the next n numbers of a part's side as doubles."""
    start, kind = part.starts[side], part.kinds[side]
    if part.packed is None:
        width = np.dtype(kind).itemsize
        file.seek(start + part.first * width)
        pull = file.read
    else:
        pull = _inflating(file, *part.packed)
        left = start
        while left:
            left -= len(pull(min(left, PIECE)))
        if side:
            tag = pull(8)
            number, _, data, _ = _tag(tag + bytes(8), 0, part.order)
            kind = TYPES[number]
            small = tag[4:] if data == 4 else b""
            plain, pull = pull, lambda n: small[:n] if small else plain(n)
        width = np.dtype(kind).itemsize

    def of(n: int) -> np.ndarray:
        data = pull(n * width)
        if len(data) < n * width:
            raise ValueError(f"variable {part.name} ends early")
        return np.frombuffer(data, np.dtype(kind).newbyteorder(part.order)).astype(float)

    return of


def _inflating(file, at: int, size: int):
    """A reader of the inflated bytes of a compressed element, a piece of it at a time."""
    unpacker, held, done = zlib.decompressobj(), bytearray(), 0

    def pull(n: int) -> bytes:
        nonlocal done
        while len(held) < n:
            source = unpacker.unconsumed_tail
            if not source:
                file.seek(at + done)
                source = file.read(min(PIECE, size - done))
                done += len(source)
                if not source:
                    break
            held.extend(unpacker.decompress(source, PIECE))
        out = bytes(held[:n])
        del held[:n]
        return out

    return pull


class MatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MatReader:
        return MatReader(dict(self.options))


def read_mat(spark: SparkSession, path: str, variable: str | None = None, cells: int = CELLS) -> DataFrame:
    """(name, cell, dims, re, im): the numeric variables of a MAT-file, or one of them; cells are numbered with the first axis fastest.

    Texts, cells, structures and sparse arrays are passed over.  ``cells``: so many to a task where a variable is stored plainly.
    """
    spark.dataSource.register(MatSource)
    reader = spark.read.format(FORMAT).option("cells", cells)
    return (reader.option("variable", variable) if variable is not None else reader).load(path)


def axes(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` of one variable with an index for each of its axes, from 0, named in order."""
    step, out = F.lit(1).cast("long"), {}
    for i, name in enumerate(names):
        size = F.coalesce(F.get("dims", F.lit(i)), F.lit(1))
        out[name] = (F.floor(F.col("cell") / step) % size).cast("int")
        step = step * size
    return rows.withColumns(out)
