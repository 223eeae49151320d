"""Tensor files as value streams: safetensors, NumPy arrays and headerless binaries.

``spark.read.format("tensors").load(path)`` has the columns name, pos, x: the tensors of a file end to end in order of their place in the file,
widened to float32.  A partition is at most SLICE bytes of one tensor, read by place, so that a large file is read in
parallel and never as a whole.  A folder is its tensor files end to end, in order of their names.  Paths may be local or URIs that
pyarrow's file systems open.

``format("tensor_windows")`` reads the same values as blocks, a partition for each count window, so that a window needs no shuffle.
"""

from __future__ import annotations

import ast
import io
import json
import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from boundwell.operators.blocks import BLOCK, BLOCK_VALUES, block_batch, block_values, blocks, gathered, windows

#: Bytes of a tensor that a partition reads.
SLICE = 64 << 20
#: Element types of safetensors headers and how their bytes are read; BF16 is the upper half of a float32. Fixed values of the format.
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1", "BOOL": "?"}


@dataclass(frozen=True)
class Tensor:
    """A tensor of a stream: offset and numel in values, start in bytes of its file. fortran: the file has its values with the first index fastest."""

    name: str
    dtype: str
    shape: tuple[int, ...]
    offset: int
    numel: int
    itemsize: int
    start: int
    path: str = ""
    fortran: bool = False


def opened(path: str):
    """The file for reading by place, and its size."""
    if "://" in path:
        fs, inner = pafs.FileSystem.from_uri(path)
    else:
        fs, inner = pafs.LocalFileSystem(), path
    f = fs.open_input_file(inner)
    return f, f.size()


def created(path: str):
    """A new file for writing in order."""
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.open_output_stream(inner)


def exists(path: str) -> bool:
    """Whether there is a file or folder at path."""
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.get_file_info(inner).type != pafs.FileType.NotFound


def make_folder(path: str) -> None:
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    fs.create_dir(inner, recursive=True)


def widen(raw: bytes, dtype: str) -> np.ndarray:
    """Bytes of an element type as float32."""
    if dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << np.uint32(16)).view(np.float32)
    return np.frombuffer(raw, TYPES.get(dtype, dtype)).astype(np.float32)


def safetensors_header(f) -> tuple[dict, int]:
    """The tensors' entries of a safetensors header, and where the data begin."""
    f.seek(0)
    (n,) = struct.unpack("<Q", f.read(8))
    entries = json.loads(f.read(n))
    entries.pop("__metadata__", None)
    return entries, 8 + n


def _safetensors(f) -> list[Tensor]:
    entries, data = safetensors_header(f)
    out, offset = [], 0
    for name, e in sorted(entries.items(), key=lambda item: item[1]["data_offsets"][0]):
        if e["dtype"] not in TYPES:
            raise ValueError(f"{name}: unsupported element type {e['dtype']}")
        numel = math.prod(e["shape"])
        out.append(Tensor(name, e["dtype"], tuple(e["shape"]), offset, numel, np.dtype(TYPES[e["dtype"]]).itemsize, data + e["data_offsets"][0]))
        offset += numel
    return out


def _npy(f) -> list[Tensor]:
    f.seek(0)
    head = f.read(12)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not a NumPy array file")
    wide = head[6] > 1
    (n,) = struct.unpack("<I", head[8:12]) if wide else struct.unpack("<H", head[8:10])
    start = (12 if wide else 10) + n
    f.seek(12 if wide else 10)
    info = ast.literal_eval(f.read(n).decode("utf-8" if head[6] > 2 else "latin1"))
    dtype = np.dtype(info["descr"])
    return [Tensor("array", dtype.str, tuple(info["shape"]), 0, math.prod(info["shape"]), dtype.itemsize, start, fortran=info["fortran_order"] and len(info["shape"]) > 1)]


def _tensors(path: str, dtype: str) -> tuple[list[Tensor], int]:
    """The tensors of one file and its size."""
    f, size = opened(path)
    with f:
        if path.endswith(".safetensors"):
            found = _safetensors(f)
        elif path.endswith(".npy"):
            found = _npy(f)
        else:
            kind = np.dtype(dtype)
            found = [Tensor("raw", kind.str, (size // kind.itemsize,), 0, size // kind.itemsize, kind.itemsize, 0)]
    return [replace(t, path=path) for t in found], size


def files_of(path: str) -> list[str]:
    """The file at path, or a folder's files in order of their names, without those that begin with a dot or an underscore."""
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    if fs.get_file_info(inner).type != pafs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(inner)) if i.type == pafs.FileType.File)
    return [f"{path.rstrip('/')}/{n}" for n in names if n[0] not in "._"]


def manifest_of(path: str, dtype: str = "float32") -> tuple[list[Tensor], int]:
    """The tensors of a file, by its ending, or of a folder's files, and their size. dtype is that of headerless files; their last partial element is left out."""
    out, total, at = [], 0, 0
    for file in files_of(path):
        found, size = _tensors(file, dtype)
        out += [replace(t, offset=t.offset + at) for t in found]
        total, at = total + size, at + sum(t.numel for t in found)
    return out, total


def data_range(path: str) -> tuple[int, int]:
    """Where a file's data begin, after its header, and end."""
    f, size = opened(path)
    with f:
        start = safetensors_header(f)[1] if path.endswith(".safetensors") else _npy(f)[0].start if path.endswith(".npy") else 0
    return start, size


def tensor_values(t: Tensor, first: int, n: int) -> Iterator[np.ndarray]:
    """n values of a tensor from the place first on, widened, in pieces."""
    if t.fortran:
        # The last index is the slowest in the file, so neighbours are far apart there.
        stored = np.memmap(t.path, np.dtype(TYPES.get(t.dtype, t.dtype)), "r", t.start, (t.numel,))
        for at in range(first, first + n, BLOCK_VALUES):
            place = np.unravel_index(np.arange(at, min(at + BLOCK_VALUES, first + n)), t.shape)
            yield stored[np.ravel_multi_index(place, t.shape, order="F")].astype(np.float32)
        return
    f, _ = opened(t.path)
    with f:
        for at in range(first, first + n, BLOCK_VALUES):
            f.seek(t.start + at * t.itemsize)
            yield widen(f.read(min(BLOCK_VALUES, first + n - at) * t.itemsize), t.dtype)


class _Slice(InputPartition):
    def __init__(self, tensor: Tensor, first: int, n: int) -> None:
        super().__init__(tensor.offset + first)
        self.tensor, self.first, self.n = tensor, first, n


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.dtype = options["path"], options.get("dtype", "float32")
        limit = options.get("limit_bytes")
        self.limit = max(1, int(limit) // 4) if limit else None

    def partitions(self) -> list[_Slice]:
        out = []
        for t in manifest_of(self.path, self.dtype)[0]:
            n = t.numel if self.limit is None else max(0, min(t.numel, self.limit - t.offset))
            step = max(1, SLICE // t.itemsize)
            out += [_Slice(t, first, min(step, n - first)) for first in range(0, n, step)]
        return out

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        t, at = partition.tensor, partition.tensor.offset + partition.first
        for x in tensor_values(t, partition.first, partition.n):
            yield pa.RecordBatch.from_arrays([pa.array([t.name] * len(x)), pa.array(np.arange(at, at + len(x))), pa.array(x)], ["name", "pos", "x"])
            at += len(x)


class _Window(InputPartition):
    def __init__(self, w: int, parts: list[tuple[Tensor, int, int]]) -> None:
        super().__init__(w)
        self.w, self.parts = w, parts


class _WindowReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.dtype, self.size = options["path"], options.get("dtype", "float32"), int(options["values_per_window"])
        limit = options.get("limit_bytes")
        self.limit = max(1, int(limit) // 4) if limit else None

    def partitions(self) -> list[_Window]:
        out: list[_Window] = []
        for t in manifest_of(self.path, self.dtype)[0]:
            stop = t.offset + t.numel if self.limit is None else min(t.offset + t.numel, self.limit)
            at = t.offset
            while at < stop:
                w = at // self.size
                end = min(stop, (w + 1) * self.size)
                if not out or out[-1].w != w:
                    out.append(_Window(w, []))
                out[-1].parts.append((t, at - t.offset, end - at))
                at = end
        return out

    def read(self, partition: _Window) -> Iterator[pa.RecordBatch]:
        place = 0
        for t, first, n in partition.parts:
            for x in tensor_values(t, first, n):
                yield block_batch(partition.w, place, x)
                place += len(x)


class WindowSource(DataSource):
    """Options: path, values_per_window, dtype (headerless files), limit_bytes (of float32 values)."""

    @classmethod
    def name(cls) -> str:
        return "tensor_windows"

    def schema(self) -> str:
        return BLOCK

    def reader(self, schema) -> DataSourceReader:
        return _WindowReader(dict(self.options))


class TensorSource(DataSource):
    """Options: path, dtype (headerless files), limit_bytes (of float32 values: only slices before it are read)."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return "name string, pos long, x float"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_stream(spark: SparkSession, path: str, dtype: str = "float32", limit_bytes: int | None = None) -> DataFrame:
    """(name, pos, x) of a tensor file."""
    spark.dataSource.register(TensorSource)
    reader = spark.read.format("tensors").option("dtype", dtype)
    if limit_bytes is not None:
        reader = reader.option("limit_bytes", str(limit_bytes))
    return reader.load(path)


def read_windows(spark: SparkSession, path: str, values_per_window: int, dtype: str = "float32", limit_bytes: int | None = None) -> DataFrame:
    """The blocks of a tensor file's windows, each window in a partition of its own and in order."""
    spark.dataSource.register(WindowSource)
    reader = spark.read.format("tensor_windows").option("dtype", dtype).option("values_per_window", str(values_per_window))
    if limit_bytes is not None:
        reader = reader.option("limit_bytes", str(limit_bytes))
    return reader.load(path)


def manifest(spark: SparkSession, path: str, dtype: str = "float32") -> DataFrame:
    """(name, dtype, shape, offset, numel, itemsize) of a file's tensors."""
    rows = [(t["name"], t["dtype"], list(t["shape"]), t["offset"], t["numel"], t["itemsize"]) for t in map(asdict, manifest_of(path, dtype)[0])]
    return spark.createDataFrame(rows, "name string, dtype string, shape array<long>, offset long, numel long, itemsize int")


def raw_bytes(path: str, limit: int | None = None, piece: int = 1 << 20) -> Iterator[bytes]:
    """The file's own bytes, without widening, piece by piece."""
    f, size = opened(path)
    left = size if limit is None else min(size, limit)
    with f:
        while left > 0 and (data := f.read(min(piece, left))):
            left -= len(data)
            yield data


def npy_header(n: int) -> bytes:
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": "<f4", "fortran_order": False, "shape": (n,)})
    return head.getvalue()


def write_flat(path: str, n: int, arrays: Iterable[np.ndarray]) -> int:
    """n values that come as arrays in order, as one flat .npy file; the number of values."""
    with created(path) as f:
        f.write(npy_header(n))
        for x in arrays:
            f.write(np.ascontiguousarray(x, "<f4").tobytes())
    return n


def write_npy(stream: DataFrame, path: str, values_per_block: int = BLOCK_VALUES) -> int:
    """A stream as one flat .npy file, written in order, a block of values in memory at a time; the number of values."""
    parts = blocks(stream, values_per_block)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, i, x in windows(batches):
            yield block_batch(w, i, x)

    rows = gathered(parts).mapInArrow(merged, BLOCK).orderBy("w").toLocalIterator()
    return write_flat(path, stream.where("x is not null").count(), (block_values(r["first"], r["places"], r["data"])[1] for r in rows))


def file_bytes(kind: str, name: str, x: np.ndarray) -> bytes:
    """One flat float32 tensor as the bytes of a file of a kind: npy, safetensors or bin (headerless)."""
    data = np.ascontiguousarray(x, "<f4").tobytes()
    if kind == "npy":
        return npy_header(len(x)) + data
    if kind == "safetensors":
        head = json.dumps({name: {"dtype": "F32", "shape": [len(x)], "data_offsets": [0, len(data)]}}).encode()
        return struct.pack("<Q", len(head)) + head + data
    if kind == "bin":
        return data
    raise ValueError(f"unknown kind of file: {kind}")


def write_files(stream: DataFrame, path: str, values_per_file: int, kind: str = "npy") -> DataFrame:
    """A stream as a folder of files, one for each values_per_file values, written by the tasks: (file, n_values).

    The folder must be one that all executors share. A file is written under another name and renamed, so that a task that runs again replaces it whole.
    """
    make_folder(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, folder = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        for w, _, x in windows(batches):
            name = f"part-{w:08d}.{kind}"
            with own.open_output_stream(f"{folder}/_{name}") as f:
                f.write(file_bytes(kind, f"part{w:08d}", x))
            own.move(f"{folder}/_{name}", f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(x)], pa.int64())], ["file", "n_values"])

    return gathered(blocks(stream, values_per_file)).mapInArrow(run, "file string, n_values long")
