"""A Spark data source of NIfTI volumes that executors write and read.

``write_volume`` deals the cells of a volume to ranges; each task compresses its own range as it streams
past.  The driver then strings the ranges together, a piece of a stream at a time, as members of one gzip
file and renames it when it is whole.  A member's header tells its length and its cells, so a
reader hops from one to the next and gives each a task; a file without such marks is one task if it is
compressed, and is cut by slices if it is not.
"""

from __future__ import annotations

import gzip
import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "fieldweave_volume"
SCHEMA = "cell long, ix int, iy int, iz int, value double"
#: Bytes that are handled at once, and numbers in a batch.
PIECE, BATCH = 1 << 20, 1 << 16
#: Size of the header with its four extension bytes, and the NIfTI code and numpy type of values.
HEADER, FLOAT32 = 352, 16
TYPES = {2: "u1", 4: "<i2", 8: "<i4", 16: "<f4", 64: "<f8"}
#: The subfield of a gzip header that tells a member's length and first and last cell.
MARK = b"FW"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def header(shape: tuple[int, int, int], affine: np.ndarray) -> bytes:
    """The header of a volume of 32-bit floats with a 3 x 4 voxel to world matrix in mm."""
    out = bytearray(HEADER)
    steps = np.linalg.norm(np.asarray(affine, float)[:, :3], axis=0)
    struct.pack_into("<i", out, 0, 348)
    struct.pack_into("<8h", out, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<2h", out, 70, FLOAT32, 32)
    struct.pack_into("<8f", out, 76, 1, *steps, 1, 1, 1, 1)
    struct.pack_into("<3f", out, 108, HEADER, 1, 0)
    struct.pack_into("<B", out, 123, 2)  # millimetres
    struct.pack_into("<2h", out, 252, 0, 1)
    struct.pack_into("<12f", out, 280, *np.asarray(affine, np.float32).ravel())
    out[344:348] = b"n+1\0"
    return bytes(out)


@dataclass
class Facts:
    """What a header tells: shape, type, where values start, how they are scaled."""

    shape: tuple[int, int, int]
    kind: np.dtype
    start: int
    slope: float
    shift: float

    @staticmethod
    def of(data: bytes) -> Facts:
        if len(data) < 348 or struct.unpack_from("<i", data, 0)[0] != 348:
            raise ValueError("not a little-endian NIfTI-1 volume")
        dims = struct.unpack_from("<8h", data, 40)
        code, (start, slope, shift) = struct.unpack_from("<h", data, 70)[0], struct.unpack_from("<3f", data, 108)
        if not 1 <= dims[0] <= 7 or code not in TYPES or any(n > 1 for n in dims[4 : dims[0] + 1]):
            raise ValueError("volumes have up to three axes of real numbers")
        shape = tuple(max(n, 1) if i < dims[0] else 1 for i, n in enumerate(dims[1:4]))
        return Facts(shape, np.dtype(TYPES[code]), int(start), slope or 1.0, shift)

    @property
    def cells(self) -> int:
        return math.prod(self.shape)


# ---------------------------------------------------------------- writing


@dataclass
class Written(WriterCommitMessage):
    """A part: its file, first and last cell, length, checksum and size of its values."""

    path: str = ""
    first: int = -1
    last: int = -1
    length: int = 0
    crc: int = 0
    size: int = 0


class VolumeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.shape = tuple(int(n) for n in options["shape"].split(","))
        self.affine = [float(x) for x in options["affine"].split(",")]
        self.parts = f"{self.path}-{uuid.uuid4().hex}.parts"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Cells in order -> raw deflate of their values, 0 where cells are missing in between."""
        system, folder = opened(self.parts)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/{uuid.uuid4().hex}"
        out, packer = Written(path=name), zlib.compressobj(6, zlib.DEFLATED, -15)
        with system.open_output_stream(name) as stream:

            def put(values: np.ndarray) -> None:
                data = values.astype("<f4").tobytes()
                out.crc, out.size = zlib.crc32(data, out.crc), out.size + len(data)
                packed = packer.compress(data)
                out.length += len(packed)
                stream.write(packed)

            for batch in iterator:
                cell, value = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "value"))
                if not len(cell):
                    continue
                steps = np.diff(cell, prepend=out.last if out.first >= 0 else cell[0] - 1)
                if (steps < 1).any() or cell[0] < 0 or cell[-1] >= math.prod(self.shape):
                    raise ValueError("cells must lie in the volume, each once and in order")
                at = int(cell[0] - steps[0] + 1)
                out.first = at if out.first < 0 else out.first
                # A wide gap is filled piece by piece, the others with the cells around them.
                wide = np.flatnonzero(steps > BATCH)
                for i, j in zip([0, *wide], [*wide, len(cell)], strict=True):
                    if i in wide:
                        for a in range(at, int(cell[i]), BATCH):
                            put(np.zeros(min(BATCH, int(cell[i]) - a)))
                        at = int(cell[i])
                    if i < j:
                        filled = np.zeros(int(cell[j - 1]) + 1 - at)
                        filled[cell[i:j] - at] = value[i:j]
                        put(filled)
                        at = int(cell[j - 1]) + 1
                out.last = at - 1
            tail = packer.flush()
            out.length += len(tail)
            stream.write(tail)
        return out

    def commit(self, messages: list[Written | None]) -> None:
        system, target = opened(self.path)
        if not self.overwrite and system.get_file_info(target).type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} exists")
        parts = sorted((m for m in messages if m is not None and m.first >= 0), key=lambda m: m.first)
        if "/" in target:
            system.create_dir(target.rpartition("/")[0], recursive=True)
        temporary, at = f"{target}.{uuid.uuid4().hex}", 0
        with system.open_output_stream(temporary) as stream:
            head = header(self.shape, np.array(self.affine).reshape(3, 4))
            for m in _member(head, -1, -1):
                stream.write(m)
            for part in parts:
                self._zeros(stream, at, part.first)
                stream.write(_start(part.length, part.first, part.last))
                with system.open_input_stream(part.path) as source:
                    while piece := source.read(PIECE):
                        stream.write(piece)
                stream.write(struct.pack("<II", part.crc, part.size & 0xFFFFFFFF))
                at = part.last + 1
            self._zeros(stream, at, math.prod(self.shape))
        system.move(temporary, target)
        self._clean()

    def _zeros(self, stream, first: int, upto: int) -> None:
        """Members of nothing but 0 for cells first..upto - 1 that no part has."""
        for a in range(first, upto, PIECE):
            b = min(a + PIECE, upto)
            for m in _member(bytes(4 * (b - a)), a, b - 1):
                stream.write(m)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        system, folder = opened(self.parts)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def _start(length: int, first: int, last: int) -> bytes:
    """A gzip header whose subfield tells the deflated length and the first and last cell."""
    mark = MARK + struct.pack("<Hqqq", 24, length, first, last)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(mark)) + mark


def _member(data: bytes, first: int, last: int) -> list[bytes]:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    return [_start(len(packed), first, last), packed, struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)]


# ---------------------------------------------------------------- reading


@dataclass
class Range(InputPartition):
    """Cells first..last, whose deflated values, or plain ones, start at a byte; first -1: a whole compressed stream."""

    kind: str
    byte: int
    length: int
    first: int
    last: int


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.slices = int(options.get("slices", "0"))
        system, name = opened(self.path)
        with system.open_input_file(name) as file:
            zipped = file.read(2) == b"\x1f\x8b"
            self.members = _members(file) if zipped else []
            file.seek(0)
            self.facts = Facts.of(_inflated(file, HEADER) if zipped else file.read(HEADER))
            self.zipped = zipped

    def partitions(self) -> list[Range]:
        if self.members:
            return [Range("member", byte, length, first, last) for byte, length, first, last in self.members if first >= 0]
        if self.zipped:
            return [Range("stream", 0, 0, 0, self.facts.cells - 1)]
        plane, width = self.facts.shape[0] * self.facts.shape[1], self.facts.kind.itemsize
        step = self.slices or max(PIECE // max(plane * width, 1), 1)
        edges = [*range(0, self.facts.shape[2], step), self.facts.shape[2]]
        return [Range("plain", self.facts.start + a * plane * width, (b - a) * plane * width, a * plane, b * plane - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, name = opened(self.path)
        with system.open_input_file(name) as file:
            if partition.kind == "stream":
                pieces = _unzipped(file, self.facts.start)
            else:
                file.seek(partition.byte)
                pieces = _read(file, partition.length, zlib.decompressobj(-15) if partition.kind == "member" else None)
            yield from self._batches(pieces, partition.first, partition.last)

    def _batches(self, pieces: Iterator[bytes], at: int, last: int) -> Iterator[pa.RecordBatch]:
        nx, ny, _ = self.facts.shape
        width, rest = self.facts.kind.itemsize, b""
        for piece in pieces:
            rest += piece
            while len(rest) >= width and at <= last:
                n = min(len(rest) // width, BATCH, last - at + 1)
                value = np.frombuffer(rest[: n * width], self.facts.kind).astype(float) * self.facts.slope + self.facts.shift
                rest, cell = rest[n * width :], np.arange(at, at + n)
                at += n
                places = [cell % nx, cell // nx % ny, cell // (nx * ny)]
                yield pa.RecordBatch.from_arrays([pa.array(cell), *[pa.array(p.astype(np.int32)) for p in places], pa.array(value)], names=["cell", "ix", "iy", "iz", "value"])
        if at <= last:
            raise ValueError(f"{self.path} ends before cell {at}")


def _read(file, length: int, unpacker) -> Iterator[bytes]:
    while length > 0:
        piece = file.read(min(PIECE, length))
        if not piece:
            return
        length -= len(piece)
        while piece:
            yield piece if unpacker is None else unpacker.decompress(piece, PIECE)
            piece = b"" if unpacker is None else unpacker.unconsumed_tail


def _unzipped(file, skip: int) -> Iterator[bytes]:
    with gzip.GzipFile(fileobj=file) as stream:
        stream.read(skip)
        while piece := stream.read(PIECE):
            yield piece


def _inflated(file, size: int) -> bytes:
    with gzip.GzipFile(fileobj=file) as stream:
        return stream.read(size)


def _members(file) -> list[tuple[int, int, int, int]]:
    """(byte, length, first, last) of marked members; none if any member has no mark."""
    out, at, size = [], 0, file.size()
    while at < size:
        file.seek(at)
        head = file.read(12 + 28)
        if len(head) < 40 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != MARK:
            return []
        length, first, last = struct.unpack_from("<qqq", head, 16)
        out.append((at + 40, length, first, last))
        at += 40 + length + 8
    return out


class VolumeSource(DataSource):
    """``spark.read.format("fieldweave_volume").load(path)`` and its writer, which ``write_volume`` calls."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> VolumeReader:
        return VolumeReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(dict(self.options), overwrite)


def read_volume(spark: SparkSession, path: str, slices: int = 0) -> DataFrame:
    """(cell, ix, iy, iz, value) of a volume; ``slices``: so many to a task where the file can be cut by slices."""
    spark.dataSource.register(VolumeSource)
    return spark.read.format(FORMAT).option("slices", slices).load(path)


def write_volume(cells: DataFrame, path: str, shape: tuple[int, int, int], affine: np.ndarray, tasks: int | None = None, overwrite: bool = True) -> None:
    """Writes cells (cell, value), x fastest, as 32-bit floats of a gzipped volume; cells that are missing are 0.

    Null values are not a number.  A cell that comes twice or lies outside fails the job, and nothing is left.
    """
    spark = cells.sparkSession
    spark.dataSource.register(VolumeSource)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.select(F.col("cell").cast("long").alias("cell"), F.col("value").cast("double").alias("value"))
    rows = rows.repartitionByRange(tasks, "cell").sortWithinPartitions("cell")
    writer = rows.write.format(FORMAT).option("shape", ",".join(map(str, shape))).option("affine", ",".join(map(repr, np.asarray(affine, float).ravel().tolist())))
    writer.mode("overwrite" if overwrite else "append").save(path)
