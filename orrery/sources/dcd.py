"""Binary trajectories as a Spark data source: spark.read.format("dcd").load(path).

Frames have a fixed size, so a file is dealt out by ranges of frames; each task reads its own bytes
only. Either byte order, 32 or 64 bit record marks, periodic boxes and fixed atoms are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "frame long, x array<double>, y array<double>, z array<double>, box struct<a: double, ang1: double, b: double, ang2: double, ang3: double, c: double>"


@dataclass
class Header:
    order: str
    mark: int
    frames: int
    first_step: int
    step: int
    atoms: int
    timestep: float
    boxed: bool
    free: list[int] = field(default_factory=list)
    start: int = 0

    def _row(self, atoms: int) -> int:
        return 3 * (4 * atoms + 2 * self.mark) + (48 + 2 * self.mark if self.boxed else 0)

    @property
    def first_size(self) -> int:
        return self._row(self.atoms)

    @property
    def size(self) -> int:
        return self._row(len(self.free) or self.atoms)

    def at(self, frame: int) -> int:
        """Offset of a frame, from 1."""
        return self.start + (0 if frame == 1 else self.first_size + (frame - 2) * self.size)


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        head = f.read(16)
        for order in "<>":
            for mark, code in ((4, "i"), (8, "q")):
                if struct.unpack(order + code, head[:mark])[0] == 84 and head[mark : mark + 4] in (b"CORD", b"VELD"):
                    return _rest(f, order, mark, code)
    raise ValueError(f"{path}: not a binary trajectory")


def _rest(f, order: str, mark: int, code: str) -> Header:
    f.seek(0)

    def record() -> bytes:
        size = struct.unpack(order + code, f.read(mark))[0]
        body = f.read(size)
        f.read(mark)
        return body

    first = record()
    control = struct.unpack(order + "9i", first[4:40])
    timestep = struct.unpack(order + "f", first[40:44])[0]
    boxed = struct.unpack(order + "i", first[44:48])[0] == 1
    record()
    atoms = struct.unpack(order + "i", record()[:4])[0]
    fixed = control[8]
    free = list(struct.unpack(order + f"{atoms - fixed}i", record())) if fixed else []
    out = Header(order, mark, control[0], control[1], control[2], atoms, timestep, boxed, free)
    out.start = f.tell()
    f.seek(0, 2)
    size = f.tell() - out.start
    out.frames = 0 if size < out.first_size else 1 + (size - out.first_size) // out.size  # what is there, not what the header says
    return out


def read_frames(path: str, begin: int, end: int) -> Iterator[tuple]:
    """Frames begin..end (from 1, both included)."""
    header = read_header(path)
    still: np.ndarray | None = None
    with open(path, "rb") as f:

        def frame(k: int) -> tuple[list[float] | None, np.ndarray]:
            f.seek(header.at(k))
            box = None
            if header.boxed:
                f.read(header.mark)
                box = np.frombuffer(f.read(48), header.order + "f8").tolist()
                f.read(header.mark)
            n = header.atoms if k == 1 or not header.free else len(header.free)
            rows = []
            for _ in range(3):
                f.read(header.mark)
                rows.append(np.frombuffer(f.read(4 * n), header.order + "f4"))
                f.read(header.mark)
            return box, np.array(rows, float)

        if header.free:
            still = frame(1)[1]
        for k in range(begin, min(end, header.frames) + 1):
            box, xyz = frame(k)
            if header.free and k > 1:
                whole = still.copy()
                whole[:, np.array(header.free) - 1] = xyz
                xyz = whole
            yield (k, *xyz.tolist(), tuple(box) if box else None)


def write(path: str, frames: Iterator[tuple], atoms: int, boxed: bool = False, first_step: int = 1, step: int = 1, timestep: float = 0.02) -> int:
    """Write (x, y, z, box) rows in their order; the number of frames."""
    count = 0
    with open(path, "wb") as f:

        def record(body: bytes) -> None:
            f.write(struct.pack("<i", len(body)) + body + struct.pack("<i", len(body)))

        def first() -> bytes:
            return b"CORD" + struct.pack("<9i", count, first_step, step, count * step, 0, 0, 0, 3 * atoms, 0) + struct.pack("<f", timestep) + struct.pack("<10i", int(boxed), *[0] * 8, 24)

        record(first())
        record(struct.pack("<i", 1) + b"* written from a frames table".ljust(80))
        record(struct.pack("<i", atoms))
        for x, y, z, box in frames:
            if boxed:
                record(struct.pack("<6d", *(box or (0.0, 90.0, 0.0, 90.0, 90.0, 0.0))))
            for axis in (x, y, z):
                record(np.asarray(axis, "<f4").tobytes())
            count += 1
        f.seek(0)
        record(first())
    return count


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int) -> None:
        super().__init__(None)
        self.path, self.begin, self.end = path, begin, end


class DcdSource(DataSource):
    """Options: path, framesperpartition (default 5000)."""

    @classmethod
    def name(cls) -> str:
        return "dcd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.width = int(options.get("framesperpartition", "5000"))

    def partitions(self) -> list[InputPartition]:
        n = read_header(self.path).frames
        return [_Range(self.path, k, min(n, k + self.width - 1)) for k in range(1, n + 1, self.width)] or [_Range(self.path, 1, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from read_frames(partition.path, partition.begin, partition.end)
