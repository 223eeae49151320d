"""Packed windows: one row of compressed byte strings per window, and back.

A window is encoded and packed in one task from its blocks, in place; its memory is the window's values and codes. Each stream is compressed
on its own.  A chunk carries the run's settings and, where they don't simply count from 0, its values' places, so that it can be decoded and verified
without anything else.  Tables of chunks are stored as Parquet, whose footers prune windows and columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundwell.operators.blocks import blocks, gathered, windows

TRIAL = pa.struct([("k", pa.int32()), ("est_bytes", pa.float64()), ("max_error", pa.float64()), ("mean_error", pa.float64())])
CHUNK = (
    "w long, mode string, error_mode string, k int, tuple_size int, n_values long, step double, labels_itemsize int, centroids binary, "
    "labels_blob binary, code_plane_blobs array<binary>, sign_blob binary, outlier_idx_blob binary, outlier_val_blob binary, n_outliers long, "
    "places_blob binary, window_values long, error_bound double, max_error double, mean_error double, search_error double, trials array<struct<k:int,est_bytes:double,max_error:double,mean_error:double>>"
)
CHUNK_TYPES = {
    "w": pa.int64(), "mode": pa.string(), "error_mode": pa.string(), "k": pa.int32(), "tuple_size": pa.int32(), "n_values": pa.int64(), "step": pa.float64(), "labels_itemsize": pa.int32(), "centroids": pa.binary(),
    "labels_blob": pa.binary(), "code_plane_blobs": pa.list_(pa.binary()), "sign_blob": pa.binary(), "outlier_idx_blob": pa.binary(), "outlier_val_blob": pa.binary(), "n_outliers": pa.int64(),
    "places_blob": pa.binary(), "window_values": pa.int64(), "error_bound": pa.float64(), "max_error": pa.float64(), "mean_error": pa.float64(), "search_error": pa.float64(), "trials": pa.list_(TRIAL),
}


def pack_places(places: np.ndarray, level: int) -> bytes:
    """The places of a window's values as compressed distances, the first from 0; nothing where they count from 0."""
    if np.array_equal(places, np.arange(len(places))):
        return b""
    return zstandard.ZstdCompressor(level=level).compress(np.diff(places, prepend=0).astype("<u8").tobytes())


def places_of(chunk: dict) -> np.ndarray:
    """Where a chunk's values stand in its window."""
    blob = chunk.get("places_blob")
    if not blob:
        return np.arange(chunk["n_values"])
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 34), "<u8").astype(np.int64))


def narrow(labels: np.ndarray, k: int) -> np.ndarray:
    return labels.astype("<u1" if k <= 1 << 8 else "<u2" if k <= 1 << 16 else "<u4")


def pack_window(w: int, mode: str, error_mode: str, centroids: np.ndarray, labels: np.ndarray, negative: np.ndarray | None, z: np.ndarray | None, step: float, outlier_idx: np.ndarray, outlier_val: np.ndarray, tuple_size: int, n_values: int, level: int) -> dict:
    """A chunk of numpy columns. z: zigzag words of the residual codes; negative: the values' signs, for log-domain modes."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    planes = []
    if z is not None:
        n_planes = 1 + sum(int(z.max(initial=0)) >= 1 << 8 * p for p in (1, 2, 3))
        planes = [squeeze(((z >> (8 * p)) & 0xFF).astype(np.uint8).tobytes()) for p in range(n_planes)]
    small = narrow(labels, len(centroids))
    return {
        "w": w, "mode": mode, "error_mode": error_mode, "k": len(centroids), "tuple_size": tuple_size, "n_values": n_values, "step": step, "labels_itemsize": small.itemsize,
        "centroids": centroids.astype("<f4").tobytes(), "labels_blob": squeeze(small.tobytes()), "code_plane_blobs": planes,
        "sign_blob": b"" if negative is None else squeeze(np.packbits(negative, bitorder="little").tobytes()),
        "outlier_idx_blob": squeeze(np.diff(outlier_idx.astype(np.int64), prepend=0).astype("<u4").tobytes()), "outlier_val_blob": squeeze(outlier_val.astype("<f4").tobytes()), "n_outliers": len(outlier_idx),
    }


def unpack_window(chunk: dict, exact_float_log: bool = False) -> np.ndarray:
    """The float32 values of a chunk.

    Logs are decoded as the JVM's expressions do, in double precision; exact_float_log decodes in single precision, as files of
    the interchange format were checked.
    """
    loose = lambda blob: zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 34) if blob else b""
    n, size = chunk["n_values"], chunk["tuple_size"]
    book = np.frombuffer(chunk["centroids"], "<f4").reshape(-1, size)
    labels = np.frombuffer(loose(chunk["labels_blob"]), f"<u{chunk['labels_itemsize']}")
    pred = book[labels].reshape(-1)[:n]
    exp = (lambda v: np.exp(v)) if exact_float_log else (lambda v: np.exp(v.astype(np.float64)))
    if chunk["code_plane_blobs"]:
        z = np.zeros(n, np.uint32)
        for p, blob in enumerate(chunk["code_plane_blobs"]):
            z |= np.frombuffer(loose(blob), np.uint8)[:n].astype(np.uint32) << np.uint32(8 * p)
        code = (z >> 1).astype(np.int64) ^ -(z & 1).astype(np.int64)
        steps = np.where(code > 0, code - 1, code).astype(np.float32)
        value = pred + steps * np.float32(chunk["step"])
    else:
        value = pred
    if chunk["sign_blob"]:
        negative = np.unpackbits(np.frombuffer(loose(chunk["sign_blob"]), np.uint8), bitorder="little")[:n].astype(bool)
        value = (np.where(negative, -1.0, 1.0).astype(np.float32) * exp(value)).astype(np.float32)
    out = np.array(value, np.float32)
    if chunk["n_outliers"]:
        at = np.cumsum(np.frombuffer(loose(chunk["outlier_idx_blob"]), "<u4").astype(np.int64))
        out[at] = np.frombuffer(loose(chunk["outlier_val_blob"]), "<f4")
    return out


def unpack(chunks: DataFrame, exact_float_log: bool = False) -> DataFrame:
    """(w, i, x) of all windows of CHUNK rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                x, i = unpack_window(chunk, exact_float_log), places_of(chunk)
                for lo in range(0, len(x), 1 << 20):
                    part = slice(lo, lo + (1 << 20))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x[part]), chunk["w"])), pa.array(i[part]), pa.array(x[part])], ["w", "i", "x"])

    return chunks.mapInArrow(run, "w long, i long, x float")


def chunk_bytes(chunks: DataFrame, *more) -> DataFrame:
    """(w, k, n_values, n_outliers, the byte counts of sizes.PARTS, and more columns). Signs and places are counted with the outliers."""
    length = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    planes = F.aggregate("code_plane_blobs", F.lit(0).cast("long"), lambda n, b: n + F.length(b))
    return chunks.select(
        "w", "k", "n_values", "n_outliers", length("centroids").alias("codebook_bytes"), length("labels_blob").alias("label_bytes"), planes.alias("code_bytes"), (length("sign_blob") + length("outlier_idx_blob") + length("outlier_val_blob") + length("places_blob")).alias("outlier_bytes"), *more
    )


def _lossless_bytes(raw: bytes, level: int) -> tuple[int, int, int]:
    """Bytes as they are, compressed, and compressed as four planes of every fourth byte (a rest of less than four is left out of these)."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    split = np.frombuffer(raw, np.uint8)[: len(raw) // 4 * 4].reshape(-1, 4)
    return len(raw), len(squeeze(raw)), sum(len(squeeze(np.ascontiguousarray(split[:, p]).tobytes())) for p in range(4))


LOSSLESS = ("raw_bytes", "plain_bytes", "planes_bytes")


def _lossless_sum(sizes: DataFrame) -> DataFrame:
    return sizes.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in LOSSLESS))


def _lossless_batch(sizes: tuple[int, int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in sizes], list(LOSSLESS))


def lossless(stream: DataFrame, level: int = 3, rows_per_block: int = 1 << 20) -> DataFrame:
    """One row (raw_bytes, plain_bytes, planes_bytes): size of the float32 stream compressed as it is, and split into its four byte planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x in windows(batches):
            yield _lossless_batch(_lossless_bytes(x.astype("<f4").tobytes(), level))

    return _lossless_sum(gathered(blocks(stream, rows_per_block)).mapInArrow(run, ", ".join(f"{c} long" for c in LOSSLESS)))


def lossless_file(spark: SparkSession, path: str, limit: int | None = None, level: int = 3, piece: int = 64 << 20) -> DataFrame:
    """The same of a file's own bytes after its header, in the width that it stores, up to limit; pieces are read and compressed by different tasks."""
    from boundwell.sources.tensors import data_range, opened

    start, stop = data_range(path)
    stop = stop if limit is None else min(stop, start + limit)
    cuts = list(range(start, stop, piece))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("at").to_pylist():
                f, _ = opened(path)
                with f:
                    f.seek(at)
                    yield _lossless_batch(_lossless_bytes(f.read(min(piece, stop - at)), level))

    parts = spark.createDataFrame([(a,) for a in cuts], "at long").repartition(max(1, len(cuts)), "at")
    return _lossless_sum(parts.mapInArrow(run, ", ".join(f"{c} long" for c in LOSSLESS)))
