"""Compressed trajectories as a Spark data source: spark.read.format("xtc").load(path).

Frames differ in size, so the file is walked once from header to header (only a few bytes of each
frame are read); ranges of frames are then read by offset in parallel. Lengths are turned from nm to
Angstrom; a box that is not rectangular is dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "frame long, step long, time double, x array<double>, y array<double>, z array<double>, box struct<a: double, b: double, c: double>"
MAGIC = 1995
NM = 10.0
FIRST = 9
# Sizes of the small steps (fixed values): 2^(k/3) rounded down, but for three of them.
SIZES = [0] * FIRST + [int(2 ** (k / 3) + 1e-9) for k in range(FIRST, 73)]
SIZES[37], SIZES[57], SIZES[69] = 5060, 524287, 8388607


class Bits:
    """Numbers cut from bytes, the highest bit first."""

    def __init__(self, body: bytes) -> None:
        self.body, self.at = body + b"\0" * 16, 0

    def take(self, n: int) -> int:
        byte, shift = divmod(self.at, 8)
        self.at += n
        window = int.from_bytes(self.body[byte : byte + (shift + n + 7) // 8], "big")
        return window >> (-(shift + n) % 8) & ((1 << n) - 1)

    def mixed(self, n: int, sizes: tuple[int, int, int]) -> tuple[int, int, int]:
        """Three numbers under their sizes from n bits, whose bytes come lowest first."""
        value = sum(self.take(min(8, n - k)) << k for k in range(0, n, 8))
        value, c = divmod(value, sizes[2])
        a, b = divmod(value, sizes[1])
        return a, b, c


class Writer:
    def __init__(self) -> None:
        self.bits: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.bits.append(format(value, f"0{n}b"))

    def mixed(self, values: tuple[int, int, int], n: int, sizes: tuple[int, int, int]) -> None:
        value = (values[0] * sizes[1] + values[1]) * sizes[2] + values[2]
        for k in range(0, n, 8):
            self.put(value >> k & 0xFF if n - k >= 8 else value >> k, min(8, n - k))

    def body(self) -> bytes:
        text = "".join(self.bits)
        text += "0" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def _half(k: int) -> int:
    return SIZES[k] // 2


def unpack(body: bytes, atoms: int, low: tuple[int, ...], high: tuple[int, ...], small: int) -> np.ndarray:
    """Whole-number coordinates (atoms, 3) of a packed frame."""
    bits = Bits(body)
    sizes = tuple(b - a + 1 for a, b in zip(low, high))
    wide = max(sizes) > 0xFFFFFF
    n_bits = 0 if wide else (sizes[0] * sizes[1] * sizes[2]).bit_length()
    out: list[tuple[int, ...]] = []
    run = 0
    while len(out) < atoms:
        whole = tuple(bits.take(s.bit_length()) for s in sizes) if wide else bits.mixed(n_bits, sizes)
        base = tuple(v + a for v, a in zip(whole, low))
        change = 0
        if bits.take(1):
            code = bits.take(5)
            change = code % 3 - 1
            run = code - code % 3
        last = base
        for k in range(0, run, 3):
            step = bits.mixed(small, (SIZES[small],) * 3)
            last = tuple(p + s - _half(small) for p, s in zip(last, step))
            out.append(last)
            if k == 0:
                out.append(base)  # the first two change places
        if not run:
            out.append(base)
        small += change
    return np.array(out[:atoms], np.int64).reshape(-1, 3)


def pack(points: np.ndarray) -> tuple[bytes, tuple[int, ...], tuple[int, ...], int]:
    """Packed whole-number coordinates, their bounds, and the size of small steps (kept through the frame)."""
    low, high = tuple(points.min(0).tolist()), tuple(points.max(0).tolist())
    sizes = tuple(b - a + 1 for a, b in zip(low, high))
    wide = max(sizes) > 0xFFFFFF
    n_bits = 0 if wide else (sizes[0] * sizes[1] * sizes[2]).bit_length()
    steps = np.abs(np.diff(points, axis=0)).max(1) if len(points) > 1 else np.zeros(1, int)
    typical = int(np.median(steps)) + 1
    small = next((k for k in range(FIRST, len(SIZES) - 1) if _half(k) > typical), len(SIZES) - 2)
    out, rows, at, run = Writer(), points.tolist(), 0, 0

    def near(a: list[int], b: list[int]) -> bool:
        return all(0 <= p - q + _half(small) < SIZES[small] for p, q in zip(a, b))

    while at < len(rows):
        group = [rows[at]]
        if at + 1 < len(rows) and near(rows[at], rows[at + 1]):
            group = [rows[at], rows[at + 1]]
            while len(group) < 9 and at + len(group) < len(rows) and near(rows[at + len(group)], group[-1] if len(group) > 2 else group[0]):
                group.append(rows[at + len(group)])
        base = group[1] if len(group) > 1 else group[0]
        whole = tuple(v - a for v, a in zip(base, low))
        if wide:
            for v, s in zip(whole, sizes):
                out.put(v, s.bit_length())
        else:
            out.mixed(whole, n_bits, sizes)
        length = 3 * (len(group) - 1)
        out.put(int(length != run), 1)
        if length != run:
            out.put(length + 1, 5)
            run = length
        last = base
        for k, row in enumerate(group):
            if k != 1:
                if len(group) > 1:
                    out.mixed(tuple(p - q + _half(small) for p, q in zip(row, last)), small, (SIZES[small],) * 3)
                last = row
        at += len(group)
    return out.body(), low, high, small


def _frame(f) -> tuple[int, int, float, list[float], int] | None:
    head = f.read(52)
    if len(head) < 52:
        return None
    magic, atoms, step, time = struct.unpack(">iiif", head[:16])
    if magic != MAGIC:
        raise ValueError("not a compressed trajectory")
    return atoms, step, time, list(struct.unpack(">9f", head[16:52])), struct.unpack(">i", f.read(4))[0]


def index(path: str) -> list[int]:
    """Offset of every frame."""
    out = []
    with open(path, "rb") as f:
        while True:
            at = f.tell()
            head = _frame(f)
            if head is None:
                return out
            out.append(at)
            if head[0] <= 9:
                f.seek(12 * head[0], 1)
            else:
                f.seek(32, 1)
                size = struct.unpack(">i", f.read(4))[0]
                f.seek(-(-size // 4) * 4, 1)


def read_frames(path: str, offsets: list[int], first: int) -> Iterator[tuple]:
    with open(path, "rb") as f:
        for k, at in enumerate(offsets):
            f.seek(at)
            atoms, step, time, box, _ = _frame(f)
            if atoms <= 9:
                xyz = np.frombuffer(f.read(12 * atoms), ">f4").reshape(-1, 3).astype(float)
            else:
                precision, *rest = struct.unpack(">f8i", f.read(36))
                body = f.read(rest[7])
                xyz = unpack(body, atoms, tuple(rest[:3]), tuple(rest[3:6]), rest[6]) / precision
            straight = not any(box[i] for i in range(9) if i % 4)
            yield (first + k, step, time, *(xyz * NM).T.tolist(), tuple(v * NM for v in box[::4]) if straight and any(box) else None)


def write(path: str, frames: Iterator[tuple], precision: float = 1000.0) -> int:
    """Write (x, y, z, box) rows, in Angstrom, in their order; the number of frames."""
    count = 0
    with open(path, "wb") as f:
        for x, y, z, box in frames:
            xyz = np.array([x, y, z], float).T / NM
            sides = [v / NM for v in box] if box else [0.0] * 3
            cell = [sides[0], 0, 0, 0, sides[1], 0, 0, 0, sides[2]]
            f.write(struct.pack(">iiif9fi", MAGIC, len(xyz), count, float(count), *cell, len(xyz)))
            if len(xyz) <= 9:
                f.write(xyz.astype(">f4").tobytes())
            else:
                body, low, high, small = pack(np.rint(xyz * precision).astype(np.int64))
                f.write(struct.pack(">f8i", precision, *low, *high, small, len(body)) + body + b"\0" * (-len(body) % 4))
            count += 1
    return count


class _Part(InputPartition):
    def __init__(self, path: str, offsets: list[int], first: int) -> None:
        super().__init__(None)
        self.path, self.offsets, self.first = path, offsets, first


class XtcSource(DataSource):
    """Options: path, framesperpartition (default 1000)."""

    @classmethod
    def name(cls) -> str:
        return "xtc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.width = int(options.get("framesperpartition", "1000"))

    def partitions(self) -> list[InputPartition]:
        offsets = index(self.path)
        return [_Part(self.path, offsets[k : k + self.width], k + 1) for k in range(0, len(offsets), self.width)] or [_Part(self.path, [], 1)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from read_frames(partition.path, partition.offsets, partition.first)
