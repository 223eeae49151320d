"""Streams as blocks: a row for each run of values of a window, which costs four bytes a value where it is moved.

A block is (w, first, places, data): float32 values of window w, the place of the first, and the distances between the places where
these don't follow each other (32-bit, the first 0), else null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = "w long, first long, places binary, data binary"
NAMES = ["w", "first", "places", "data"]
#: Values of a block, at most.
BLOCK_VALUES = 1 << 20


def block_batch(w: int, i: np.ndarray | int, x: np.ndarray) -> pa.RecordBatch:
    """One block; i: its places, or the place of the first of values that follow each other."""
    first, places = (i, None) if isinstance(i, int) else (int(i[0]), None)
    if not isinstance(i, int):
        gaps = np.diff(i, prepend=i[0])
        places = gaps.astype("<u4").tobytes() if (gaps[1:] != 1).any() else None
    columns = [pa.array([w], pa.int64()), pa.array([first], pa.int64()), pa.array([places], pa.binary()), pa.array([np.ascontiguousarray(x, "<f4").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def block_values(first: int, places: bytes | None, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a block."""
    x = np.frombuffer(data, "<f4")
    return first + (np.arange(len(x)) if places is None else np.cumsum(np.frombuffer(places, "<u4").astype(np.int64))), x


def blocks(stream: DataFrame, values_per_window: int) -> DataFrame:
    """The blocks of a stream (pos, x), made where its rows are; nulls are not values of a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> Iterator[pa.RecordBatch]:
            pos, x = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            if (pos[1:] <= pos[:-1]).any():
                order = np.argsort(pos, kind="stable")
                pos, x = pos[order], x[order]
            w = pos // values_per_window
            edges = [0, *(np.flatnonzero(w[1:] != w[:-1]) + 1).tolist(), len(w)]
            for a, b in zip(edges, edges[1:], strict=False):
                yield block_batch(int(w[a]), pos[a:b] - w[a] * values_per_window, x[a:b])

        n = 0
        for batch in batches:
            batch = batch.drop_null()
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                n += batch.num_rows
            if n >= BLOCK_VALUES:
                yield from told()
                held, n = [], 0
        if n:
            yield from told()

    return stream.select("pos", "x").mapInArrow(run, BLOCK)


def gathered(blocks_: DataFrame) -> DataFrame:
    """Blocks with those of a window together, in order."""
    return blocks_.repartition("w").sortWithinPartitions("w", "first")


def joined(w: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a window's blocks, in order of the places."""
    i, x = (np.concatenate([p[k] for p in parts]) if len(parts) > 1 else parts[0][k] for k in (0, 1))
    if (i[1:] <= i[:-1]).any():
        order = np.argsort(i, kind="stable")
        i, x = i[order], x[order]
        if (i[1:] == i[:-1]).any():
            raise ValueError(f"a place of window {w} has several values")
    return i, x


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(w, places, values) of each window of gathered blocks, one at a time."""
    key, parts = None, []
    for batch in batches:
        for w, first, places, data in zip(*(batch.column(n).to_pylist() for n in ("w", "first", "places")), batch.column("data"), strict=True):
            if w != key and parts:
                yield key, *joined(key, parts)
                parts = []
            key = w
            parts.append(block_values(first, places, data.as_buffer()))
    if parts:
        yield key, *joined(key, parts)
