"""Entry points: compress, decompress, verify, sweep."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from boundwell.config import Config
from boundwell.operators import cluster, packing, sizes, verify
from boundwell.operators.blocks import blocks, gathered, windows
from boundwell.operators.encode import encode_window
from boundwell.sources.tensors import read_windows, write_flat


def pack(gathered_blocks: DataFrame, cfg: Config) -> DataFrame:
    """Chunk table (packing.CHUNK) of blocks of which a window's stand together in order: windows are encoded and packed where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(packing.CHUNK_TYPES)
        for w, places, x in windows(batches):
            yield pa.RecordBatch.from_pylist([encode_window(w, places, x, cfg)], schema=kind)

    return gathered_blocks.mapInArrow(run, packing.CHUNK)


def compress(stream: DataFrame, cfg: Config) -> DataFrame:
    """Chunk table of a stream (pos, x): what is shuffled is blocks, by window."""
    return pack(gathered(blocks(stream, cfg.values_per_window)), cfg)


def compress_file(spark: SparkSession, path: str, cfg: Config, dtype: str = "float32", limit_bytes: int | None = None) -> DataFrame:
    """Chunk table of a tensor file, which is read by windows: a window is packed in the task that reads it, and nothing is shuffled."""
    return pack(read_windows(spark, path, cfg.values_per_window, dtype, limit_bytes), cfg)


def decompress(chunks: DataFrame, values_per_window: int | None = None, exact_float_log: bool = False) -> DataFrame:
    """The stream (pos, x) of a chunk table. values_per_window is that of the run, which the chunks know."""
    known = chunks if values_per_window is None else chunks.withColumn("window_values", F.lit(values_per_window).cast("long"))
    sized = known.withColumn("w", F.col("w") * F.col("window_values"))
    return packing.unpack(sized, exact_float_log).select((F.col("w") + F.col("i")).alias("pos"), "x")


def write_decoded(chunks: DataFrame, path: str, exact_float_log: bool = False) -> int:
    """The values of a chunk table as one flat .npy file, a window in memory at a time; the number of values."""
    rows = chunks.orderBy("w").toLocalIterator()
    return write_flat(path, chunks.agg(F.coalesce(F.sum("n_values"), F.lit(0))).first()[0], (packing.unpack_window(r.asDict(), exact_float_log) for r in rows))


def settings(chunks: DataFrame) -> Row:
    """n, window_values, error_bound, error_mode, mode of a run; a table of several runs is refused."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("window_values", "error_bound", "error_mode", "mode") for f in (F.min, F.max)]
    found = chunks.agg(F.count("*").alias("n"), *ends).first()
    names = ("window_values", "error_bound", "error_mode", "mode")
    if any(found[f"min_{c}"] != found[f"max_{c}"] for c in names):
        raise ValueError("the chunks are of runs with different settings")
    if found.n and found.min_window_values is None:
        raise ValueError("the chunks don't know their run's settings")
    return Row("n", *names)(found.n, *(found[f"min_{c}"] for c in names))


def verify_chunks(stream: DataFrame | None, chunks: DataFrame, cfg: Config | None = None, exact_float_log: bool = False, source: DataFrame | None = None) -> DataFrame:
    """One row: n_values, n_windows, max_error, violations, unmatched, passed.

    Windows are those that the chunks were made with, and so is the bound, unless cfg gives another one. source: the stream's
    blocks, where they are at hand. A place that the source or the chunks lack is a failure.
    """
    known = settings(chunks)
    bound = known.error_bound if cfg is None else cfg.error_bound
    relative = (known.error_mode if cfg is None else cfg.error_mode) == "relative"
    own = blocks(stream, known.window_values or 1 << 25) if source is None else source
    return verify.run_verdict(verify.check_windows(own, chunks, relative, 0.0 if bound is None else bound, exact_float_log), bound)


def write_run(chunks: DataFrame, path: str, progress: Callable[[Row], None] | None = None) -> None:
    """Store a chunk table; its columns and windows can then be read alone. progress is called with each window's row of stats()."""
    chunks.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    if progress is not None:
        for row in stats(read_run(chunks.sparkSession, path)).orderBy("w").toLocalIterator():
            progress(row)


def write_codebooks(chunks: DataFrame, path: str) -> None:
    """The codebooks alone, by window."""
    chunks.select("w", "k", "tuple_size", "centroids").write.mode("overwrite").partitionBy("w").parquet(f"{path}/codebooks")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(packing.CHUNK).parquet(f"{path}/chunks")


def sweep(rows: DataFrame, bounds: Sequence[float], k_start: int = 64, max_k: int = 1 << 24) -> DataFrame:
    """(bound, w, n, k, occupied, n_escapes, max_error, mean_error): cluster mode at several bounds, from one pass over the values."""
    return cluster.window_stats(cluster.encode_bounds(rows, bounds, k_start, max_k), "bound")


def stats(chunks: DataFrame) -> DataFrame:
    """Report rows of the windows: k, values, escapes, byte counts and their shares, ratio, bits a value, errors, the error and the number of the search's trials."""
    sized = packing.chunk_bytes(chunks, "mode", "max_error", "mean_error", "search_error", F.size(F.coalesce("trials", F.array())).alias("trials")).withColumn("occupied", F.col("k"))
    return sizes.shares(sizes.chunk_stats(sized))
