"""Comparison of a decoded stream with its source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundwell.functions import scalar as S
from boundwell.operators import packing
from boundwell.operators.blocks import block_values, joined
from boundwell.operators.encode import TILE


def compare(source: DataFrame, decoded: DataFrame, relative: bool = True) -> DataFrame:
    """(w, i, x, y, err): values of both streams by place. A relative error at 0 is 0; values that are not finite must be the same."""
    both = source.select("w", "i", "x").join(decoded.select("w", "i", F.col("x").alias("y")), ["w", "i"])
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    plain = F.when(F.col("x") == 0, F.lit(0.0)).otherwise(S.relative_error(F.col("y"), F.col("x"))) if relative else F.abs(y - x)
    strange = ~S.finite(F.col("x")) | ~S.finite(F.col("y"))
    return both.withColumn("err", F.when(strange, F.when(F.col("x").eqNullSafe(F.col("y")), F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(plain))


def verdict(compared: DataFrame, bound: float) -> DataFrame:
    """One row (n_values, n_windows, max_error, violations, passed)."""
    by_window = compared.groupBy("w").agg(F.count("*").alias("n"), F.max("err").alias("worst"), F.count_if(F.col("err") > bound).alias("bad"))
    total = by_window.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"), F.count("*").alias("n_windows"), F.coalesce(F.max("worst"), F.lit(0.0)).alias("max_error"), F.coalesce(F.sum("bad"), F.lit(0)).alias("violations"))
    return total.withColumn("passed", F.col("violations") == 0)


def unmatched(source: DataFrame, decoded: DataFrame) -> DataFrame:
    """Places that only one of the streams has; a comparison by place doesn't see them."""
    a, b = source.select("w", "i", F.lit(1).alias("in_source")), decoded.select("w", "i", F.lit(1).alias("in_decoded"))
    return a.join(b, ["w", "i"], "full_outer").where("in_source is null or in_decoded is null")


def window_errors(x: np.ndarray, y: np.ndarray, relative: bool, bound: float) -> tuple[float, int]:
    """The worst error of y against x and how many are over the bound; as compare() has it, a tile at a time."""
    worst, over = 0.0, 0
    with np.errstate(invalid="ignore"):
        for at in range(0, len(x), TILE):
            a, b = x[at : at + TILE].astype(float), y[at : at + TILE].astype(float)
            err = np.abs(b - a)
            if relative:
                err = np.where(a == 0, 0.0, err / np.maximum(np.abs(a), S.TINY))
            strange = ~np.isfinite(a) | ~np.isfinite(b)
            err = np.where(strange, np.where((a == b) | (np.isnan(a) & np.isnan(b)), 0.0, np.inf), err)
            worst, over = max(worst, float(err.max(initial=0.0))), over + int((err > bound).sum())
    return worst, over


def check_windows(source: DataFrame, chunks: DataFrame, relative: bool, bound: float, exact_float_log: bool = False) -> DataFrame:
    """(w, both, n, worst, bad, unmatched) of each window of a stream's blocks and of chunks: values that meet by place, and those that don't.

    What is moved is blocks and chunks, not values; a task holds one window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, decoded = None, [], []

        def told() -> pa.RecordBatch:
            (i, x), (j, y) = (joined(key, p) if p else (np.zeros(0, np.int64), np.zeros(0, np.float32)) for p in (own, decoded))
            if not np.array_equal(i, j):
                _, a, b = np.intersect1d(i, j, assume_unique=True, return_indices=True)
                lost, x, y = len(i) + len(j) - 2 * len(a), x[a], y[b]
            else:
                lost = 0
            worst, bad = window_errors(x, y, relative, bound)
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([bool(own and decoded)]), *(pa.array([v], t) for v, t in ((len(x), pa.int64()), (worst, pa.float64()), (bad, pa.int64()), (lost, pa.int64())))], ["w", "both", "n", "worst", "bad", "unmatched"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["w"] != key and (own or decoded):
                    yield told()
                    own, decoded = [], []
                key = row["w"]
                if row["data"] is not None:
                    own.append(block_values(row["first"], row["places"], row["data"]))
                else:
                    decoded.append((packing.places_of(row), packing.unpack_window(row, exact_float_log)))
        if own or decoded:
            yield told()

    both = source.unionByName(chunks.select(*(c for c in packing.CHUNK_TYPES if c not in ("trials", "max_error", "mean_error", "search_error"))), allowMissingColumns=True)
    return both.repartition("w").sortWithinPartitions("w", "first").mapInArrow(run, "w long, both boolean, n long, worst double, bad long, unmatched long")


def run_verdict(checked: DataFrame, bound: float) -> DataFrame:
    """One row (n_values, n_windows, max_error, violations, unmatched, passed): places that only one side has fail."""
    sums = ((F.sum("n"), "n_values"), (F.count_if("both"), "n_windows"), (F.max("worst"), "max_error"), (F.sum("bad"), "violations"), (F.sum("unmatched"), "unmatched"))
    total = checked.agg(*(F.coalesce(e, F.lit(0.0 if n == "max_error" else 0)).alias(n) for e, n in sums))
    return total.withColumn("passed", (F.col("violations") == 0) & (F.col("unmatched") == 0))
