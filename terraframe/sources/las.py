"""Uncompressed LAS files as a Spark data source: read by ranges of records, headers alone, written a file a group.

    spark.dataSource.register(LasSource)
    spark.read.format("las").load(folder)                            # points
    spark.read.format("las").option("headers", "true").load(folder)  # a row a file
    df.write.format("las").save(folder)                              # a file for each value of `file`

A file is cut in ranges of SPLIT bytes, many small files share a task, and a task reads the header and its own records
only, BATCH bytes at a time. Comparisons of x and y with constants are pushed down to whole files by the box in their header. Files are
opened through Arrow's file systems, so local, HDFS, S3 and GCS paths work; contents never pass the driver.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Public header: places and kinds of its fields.
FIELDS = {"minor": (25, "<B"), "offset": (96, "<I"), "format": (104, "<B"), "length": (105, "<H"), "count32": (107, "<I"), "scales": (131, "<3d"), "offsets": (155, "<3d"), "box": (179, "<6d"), "count64": (247, "<Q")}
#: Bytes that hold every header field read here; of a range of records; of a batch; files whose headers one task reads.
HEADER, SPLIT, BATCH, FILES = 375, 128 << 20, 4 << 20, 512
POINTS = "cloud string, pid long, x double, y double, z double, cls int, nret int, rnum int, intensity double, withheld boolean"
HEADERS = "path string, minor int, n_points long, min_x double, max_x double, min_y double, max_y double, density double"
#: Format and record size of files that are written, and the step of their coordinates.
FORMAT, LENGTH, STEP = 6, 30, 1e-4


@dataclass
class Head:
    minor: int
    offset: int
    form: int
    length: int
    n: int
    scales: tuple[float, ...]
    offsets: tuple[float, ...]
    #: max x, min x, max y, min y, max z, min z
    box: tuple[float, ...]


def head_of(raw: bytes) -> Head | None:
    """The header's fields, or None for a file that isn't an uncompressed LAS file."""
    if len(raw) < 227 or raw[:4] != b"LASF":
        return None
    one = lambda k: struct.unpack_from(FIELDS[k][1], raw, FIELDS[k][0])
    minor, form = one("minor")[0], one("format")[0]
    if form > 127:
        return None
    n = one("count64")[0] if minor >= 4 and len(raw) >= 255 else 0
    return Head(minor, one("offset")[0], form, one("length")[0], n or one("count32")[0], one("scales"), one("offsets"), one("box"))


def records(raw: bytes, head: Head) -> dict[str, np.ndarray]:
    """The columns of whole records, formats 0 to 10."""
    rows = np.frombuffer(raw, np.uint8).reshape(-1, head.length)
    take = lambda at, kind: np.ascontiguousarray(rows[:, at : at + np.dtype(kind).itemsize]).view(kind).ravel()
    out = {c: take(4 * i, "<i4") * head.scales[i] + head.offsets[i] for i, c in enumerate("xyz")}
    flags = rows[:, 14]
    if head.form >= 6:
        out |= {"cls": rows[:, 16], "nret": flags >> 4, "rnum": flags & 15, "withheld": (rows[:, 15] & 4) > 0}
    else:
        out |= {"cls": rows[:, 15] & 31, "nret": (flags >> 3) & 7, "rnum": flags & 7, "withheld": (rows[:, 15] & 128) > 0}
    return out | {"intensity": take(12, "<u2").astype(float)}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the .las files of a path, its folders and theirs, whatever the case of their endings; nothing is opened."""
    fs, base = file_system(path)
    info = fs.get_file_info(base.rstrip("/"))
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base.rstrip("/"), recursive=True)) if info.type == pafs.FileType.Directory else []
    hidden = lambda i: any(p.startswith(("_", ".")) for p in i.path[len(base) :].strip("/").split("/"))
    return sorted((i.path, i.size) for i in found if i.type == pafs.FileType.File and i.path.lower().endswith(".las") and not hidden(i))


@dataclass
class Ranges(InputPartition):
    """(file, first byte, byte after the last) of every range of a task."""

    parts: list[tuple[str, int, int]]


class LasReader(DataSourceReader):
    def __init__(self, path: str, headers: bool, split: int = SPLIT) -> None:
        self.path, self.headers, self.split = path, headers, split
        #: Bounds of x and y that a file's box must meet.
        self.low, self.high = {"x": -np.inf, "y": -np.inf}, {"x": np.inf, "y": np.inf}
        self.bytes_read = 0

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes bounds of x and y for files; all filters are given back, as rows are still to be filtered."""
        for f in filters:
            c = f.attribute[0] if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else None
            if c in self.low and isinstance(f.value, (int, float)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[c] = max(self.low[c], float(f.value))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[c] = min(self.high[c], float(f.value))
            yield f

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for name, length in listed(self.path):
            step = length if self.headers else self.split
            for lo in range(0, max(length, 1), max(step, 1)):
                hi = min(lo + step, length)
                cost = HEADER if self.headers else hi - lo
                if held and (size + cost > self.split or len(held) >= FILES):
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append((name, lo, hi))
                size += cost
        return [*out, Ranges(held)] if held else out or [Ranges([])]

    def _take(self, file: pa.NativeFile, at: int, n: int) -> bytes:
        file.seek(at)
        raw = file.read(n)
        self.bytes_read += len(raw)
        return raw

    def _meets(self, head: Head) -> bool:
        hi_x, lo_x, hi_y, lo_y = head.box[:4]
        return lo_x <= self.high["x"] and hi_x >= self.low["x"] and lo_y <= self.high["y"] and hi_y >= self.low["y"]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        if self.headers:
            yield self._headers(fs, partition)
            return
        for name, lo, hi in partition.parts:
            with fs.open_input_file(name) as file:
                head = head_of(self._take(file, 0, HEADER))
                if head is None or not head.n or not self._meets(head):
                    continue
                # records that begin in the range
                first, last = (min(head.n, max(0, -(-(at - head.offset) // head.length))) for at in (lo, hi))
                cloud, step = name.rsplit("/", 1)[-1].rsplit(".", 1)[0], max(1, BATCH // head.length)
                for k in range(first, last, step):
                    n = min(step, last - k)
                    raw = self._take(file, head.offset + k * head.length, n * head.length)
                    if len(raw) < n * head.length:
                        raise ValueError(f"{name} ends before its last record")
                    p = records(raw, head)
                    kinds = {"cls": pa.int32(), "nret": pa.int32(), "rnum": pa.int32()}
                    named = {"cloud": pa.array([cloud]).take(pa.array(np.zeros(n, np.int64))), "pid": pa.array(np.arange(k, k + n))}
                    named |= {c: pa.array(p[c]).cast(kinds[c]) if c in kinds else pa.array(p[c]) for c in ("x", "y", "z", "cls", "nret", "rnum", "intensity", "withheld")}
                    yield pa.RecordBatch.from_pydict(named)

    def _headers(self, fs: pafs.FileSystem, partition: Ranges) -> pa.RecordBatch:
        rows = []
        for name, _, _ in partition.parts:
            with fs.open_input_file(name) as file:
                head = head_of(self._take(file, 0, HEADER))
            if head is not None and self._meets(head):
                hi_x, lo_x, hi_y, lo_y = head.box[:4]
                area = (hi_x - lo_x) * (hi_y - lo_y)
                rows.append((name, head.minor, head.n, lo_x, hi_x, lo_y, hi_y, head.n / area if area > 0 else None))
        kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.float64()] * 5]
        names = [f.split()[0] for f in HEADERS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


@dataclass
class Written(WriterCommitMessage):
    #: Temporary and final name of every file.
    files: list[tuple[str, str]] = field(default_factory=list)


def header_bytes(n: int, lows: list[float], highs: list[float]) -> bytes:
    """A version 1.4 header of n records."""
    raw = bytearray(HEADER)
    raw[:4] = b"LASF"
    struct.pack_into("<BB", raw, 24, 1, 4)
    struct.pack_into("<HI", raw, 94, HEADER, HEADER)
    struct.pack_into("<BHI", raw, 104, FORMAT, LENGTH, n if n < 1 << 32 else 0)
    struct.pack_into("<3d3d", raw, 131, *[STEP] * 3, 0.0, 0.0, 0.0)
    struct.pack_into("<6d", raw, 179, *[v for hi, lo in zip(highs, lows) for v in (hi, lo)])
    struct.pack_into("<Q", raw, 247, n)
    return bytes(raw)


class LasWriter(DataSourceArrowWriter):
    """Rows that lie together by `file` become a file of that name; x, y and z are stored in steps of STEP, intensity from 0 to 65535."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        done, out, name, n = Written(), None, None, 0
        low, high = np.full(3, np.inf), np.full(3, -np.inf)

        def close() -> None:
            if out is not None:
                out.close(header_bytes(n, list(low), list(high)))

        for batch in iterator:
            names = batch.column(batch.schema.get_field_index("file")).to_pylist()
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if names[lo] != name or out is None:
                    close()
                    name, n = names[lo], 0
                    low, high = np.full(3, np.inf), np.full(3, -np.inf)
                    final = f"{base.rstrip('/')}/{name}.las"
                    if any(f == final for _, f in done.files):
                        raise ValueError(f"rows of {name} do not lie together")
                    spare = f"{base.rstrip('/')}/.{name}-{uuid.uuid4().hex}.part"
                    done.files.append((spare, final))
                    out = _Body(fs, spare)
                part = batch.slice(lo, hi - lo)
                col = lambda c: part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                steps = np.stack([np.rint(col(c) / STEP) for c in "xyz"], axis=1)
                low, high = np.minimum(low, steps.min(axis=0) * STEP), np.maximum(high, steps.max(axis=0) * STEP)
                rows = np.zeros((hi - lo, LENGTH), np.uint8)
                rows[:, :12] = np.ascontiguousarray(steps.astype("<i4")).view(np.uint8)
                rows[:, 12:14] = np.ascontiguousarray(np.clip(col("intensity"), 0, 65535).astype("<u2")[:, None]).view(np.uint8)
                rows[:, 14] = (np.clip(col("nret"), 0, 15).astype(np.uint8) << 4) | np.clip(col("rnum"), 0, 15).astype(np.uint8)
                rows[:, 15] = np.where(col("withheld").astype(bool), 4, 0)
                rows[:, 16] = col("cls").astype(np.uint8)
                out.write(rows.tobytes())
                n += hi - lo
        close()
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            for spare, final in m.files if m else []:
                fs.move(spare, final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            for spare, _ in m.files if m else []:
                fs.delete_file(spare)


class _Body:
    """The records of a file on their way; the header, which needs all of them, is put before them at the end, as object stores cannot seek."""

    def __init__(self, fs: pafs.FileSystem, name: str) -> None:
        self.fs, self.name = fs, name
        self.stream = fs.open_output_stream(name + ".body")

    def write(self, raw: bytes) -> None:
        self.stream.write(raw)

    def close(self, header: bytes) -> None:
        self.stream.close()
        with self.fs.open_output_stream(self.name) as out, self.fs.open_input_stream(self.name + ".body") as body:
            out.write(header)
            while raw := body.read(BATCH):
                out.write(raw)
        self.fs.delete_file(self.name + ".body")


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return HEADERS if self._headers() else POINTS

    def _headers(self) -> bool:
        return self.options.get("headers", "false").lower() == "true"

    def reader(self, schema) -> LasReader:
        return LasReader(self.options["path"], self._headers(), int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> LasWriter:
        return LasWriter(self.options["path"])
