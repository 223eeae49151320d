"""Single-file containers of packed windows, for exchange with other tools; chunk tables in Parquet are the engine's own form.

A file is: MAGIC, version and a zero as 32-bit numbers, the chunks' payloads, a JSON footer, its length as a 64-bit number, MAGIC.
A chunk whose values don't stand one after another has their places behind its other payloads, and their length in its entry.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from boundwell.operators.packing import CHUNK, CHUNK_TYPES
from boundwell.sources.tensors import created, opened

# Fixed values of the format.
MAGIC = b"WPRS"
VERSION = 2
HEAD = struct.Struct("<4sII")
TAIL = struct.Struct("<Q4s")


def _blobs(chunk: dict) -> list[bytes]:
    """A chunk's payloads, in the format's order."""
    return [chunk["centroids"], *chunk["code_plane_blobs"], chunk["sign_blob"], chunk["labels_blob"], chunk["outlier_idx_blob"], chunk["outlier_val_blob"], chunk["places_blob"] or b""]


def write_container(chunks: DataFrame, path: str, meta: dict) -> int:
    """Write a chunk table as one container, a window in memory at a time; the number of windows. A failed write leaves no footer.

    The footer has the run's error bound and window size, in bytes, whether or not meta names them.
    """
    entries, known = [], {}
    with created(path) as f:
        f.write(HEAD.pack(MAGIC, VERSION, 0))
        for row in chunks.orderBy("w").toLocalIterator():
            c = row.asDict()
            at = f.tell()
            known = {"error_bound": c["error_bound"], "window_size": 4 * c["window_values"], "error_mode": c["error_mode"]}
            for blob in _blobs(c):
                f.write(blob)
            entries.append({
                "index": c["w"], "offset": at, "k": c["k"], "tuple_size": c["tuple_size"], "n_values": c["n_values"], "mode": c["mode"], "labels_itemsize": c["labels_itemsize"], "n_outliers": c["n_outliers"], "step": c["step"], "error_mode": c["error_mode"],
                "sign_len": len(c["sign_blob"]), "centroid_bytes": len(c["centroids"]), "code_plane_lens": [len(b) for b in c["code_plane_blobs"]], "labels_blob_len": len(c["labels_blob"]), "outlier_idx_blob_len": len(c["outlier_idx_blob"]), "outlier_val_blob_len": len(c["outlier_val_blob"]),
                **({"places_blob_len": len(c["places_blob"])} if c["places_blob"] else {}),
            })
        footer = json.dumps({**known, **meta, "chunks": entries}).encode()
        f.write(footer + TAIL.pack(len(footer), MAGIC))
    return len(entries)


def read_footer(path: str) -> dict:
    """The footer; ValueError for anything that isn't a whole container."""
    f, size = opened(path)
    with f:
        if size < HEAD.size + TAIL.size:
            raise ValueError(f"{path}: too short for a container")
        magic, version, _ = HEAD.unpack(f.read(HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{path}: not a container of version {VERSION}")
        f.seek(size - TAIL.size)
        n, magic = TAIL.unpack(f.read(TAIL.size))
        if magic != MAGIC or n > size - HEAD.size - TAIL.size:
            raise ValueError(f"{path}: the container is cut short")
        f.seek(size - TAIL.size - n)
        return json.loads(f.read(n))


def read_chunk(f, entry: dict, footer: dict) -> dict:
    """One chunk of an open container. What containers don't store (errors and trials) is null."""
    sizes = [entry["centroid_bytes"], *entry["code_plane_lens"], entry["sign_len"], entry["labels_blob_len"], entry["outlier_idx_blob_len"], entry["outlier_val_blob_len"], entry.get("places_blob_len", 0)]
    f.seek(entry["offset"])
    blobs = [f.read(n) for n in sizes]
    if [len(b) for b in blobs] != sizes:
        raise ValueError("a chunk is cut short")
    p = len(entry["code_plane_lens"])
    same = {k: entry[k] for k in ("k", "tuple_size", "n_values", "mode", "labels_itemsize", "n_outliers", "step", "error_mode")}
    return same | {"w": entry["index"], "centroids": blobs[0], "code_plane_blobs": blobs[1 : 1 + p], "sign_blob": blobs[1 + p], "labels_blob": blobs[2 + p], "outlier_idx_blob": blobs[3 + p], "outlier_val_blob": blobs[4 + p], "places_blob": blobs[5 + p], "window_values": footer["window_size"] // 4 if "window_size" in footer else None, "error_bound": footer.get("error_bound")}


class _Chunk(InputPartition):
    def __init__(self, entry: dict, footer: dict) -> None:
        super().__init__(entry["index"])
        self.entry, self.footer = entry, footer


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[_Chunk]:
        footer = read_footer(self.path)
        entries = footer.pop("chunks")
        return [_Chunk(e, footer) for e in entries]

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        f, _ = opened(self.path)
        with f:
            yield pa.RecordBatch.from_pylist([read_chunk(f, partition.entry, partition.footer)], schema=pa.schema(CHUNK_TYPES))


class ContainerSource(DataSource):
    """A row of a chunk table for each window; one partition per window."""

    @classmethod
    def name(cls) -> str:
        return "window_container"

    def schema(self) -> str:
        return CHUNK

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_container(spark: SparkSession, path: str) -> DataFrame:
    read_footer(path)
    spark.dataSource.register(ContainerSource)
    return spark.read.format("window_container").load(path)
