"""The flat value stream and its count windows.

A stream is a DataFrame (pos long, x float). Order is the explicit pos, never the order of rows, and a window is arithmetic on it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwell.functions import scalar as S


def flat_arrays(rows: DataFrame, id_col: str, array_col: str, size: int) -> DataFrame:
    """Arrays of up to `size` numbers each, by the id: a shorter one leaves a gap, a longer one is refused. Nulls are not values of a stream."""
    fits = F.when(F.size(array_col) > size, F.raise_error(F.lit(f"an array has more than {size} values"))).otherwise(F.col(array_col))
    one = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.posexplode(fits).alias("at", "v")).where("v is not null")
    return one.select((F.col("id") * size + F.col("at")).alias("pos"), S.widen(F.col("v")).alias("x"))


def flat_column(rows: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """A numeric column in order of an integer key; rows without a value are not part of the stream."""
    one = rows.where(F.col(value_col).isNotNull() & F.col(id_col).isNotNull())
    return one.select(F.col(id_col).cast("long").alias("pos"), S.widen(F.col(value_col)).alias("x"))


def limit_values(stream: DataFrame, limit_bytes: int | None) -> DataFrame:
    """The first limit_bytes of 4-byte values, at least one: a predicate on pos that a scan can use."""
    return stream if limit_bytes is None else stream.where(F.col("pos") < max(1, limit_bytes // 4))


def windowed(stream: DataFrame, values_per_window: int) -> DataFrame:
    """Adds w and i, the window and the place in it; the last window may be short."""
    return stream.withColumns({"w": F.floor(F.col("pos") / values_per_window).cast("long"), "i": F.pmod("pos", F.lit(values_per_window)).cast("long")})


def tuples(rows: DataFrame, size: int, value: str = "x") -> DataFrame:
    """(w, t, v0 .. v{size-1}): neighbours of a window side by side; a short last tuple repeats the window's last value."""
    t = F.floor(F.col("i") / size).cast("long")
    lanes = [F.max_by(value, F.when(F.col("i") % size == j, F.col("i"))).alias(f"v{j}") for j in range(size)]
    wide = rows.groupBy("w", t.alias("t")).agg(*lanes, F.max_by(value, "i").alias("_last"), F.max(F.col("i") % size).alias("_top"))
    return wide.select("w", "t", *(F.when(F.col("_top") >= j, F.col(f"v{j}")).otherwise(F.col("_last")).alias(f"v{j}") for j in range(size)))


def concat(streams: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Streams of known lengths, end to end."""
    out, at = None, 0
    for stream, n in streams:
        moved = stream.withColumn("pos", F.col("pos") + at)
        out, at = moved if out is None else out.unionByName(moved), at + n
    if out is None:
        raise ValueError("no streams")
    return out


def every(rows: DataFrame, place: Column, n: int, most: int) -> DataFrame:
    """Every stride-th row, so that about `most` of n are left; all if there are fewer."""
    stride = max(1, n // most)
    return rows if stride == 1 else rows.where(place % stride == 0)


def pack_signs(rows: DataFrame) -> DataFrame:
    """(w, byte, bits): signs of eight neighbours as one number, the first in the lowest bit; 1 is negative."""
    bit = F.when(F.col("x") < 0, F.pow(F.lit(2.0), F.col("i") % 8).cast("int")).otherwise(0)
    return rows.groupBy("w", F.floor(F.col("i") / 8).cast("long").alias("byte")).agg(F.sum(bit).cast("int").alias("bits"))


#: Values of a slice of a restored tensor, and of the grain by which values meet their tensors.
SLICE_VALUES = 1 << 16


def restore(stream: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, shape, offset, numel, first, values): the stream's values by tensor, in slices that begin at the place `first` of the tensor.

    Tensors that the stream doesn't hold whole are left out; empty ones that begin inside it are one empty slice. manifest: name, shape,
    offset, numel. The stream meets it by grains of a fixed size, so that this is an equi-join, and no row grows with a tensor.
    """
    grain = SLICE_VALUES
    held = manifest.where("numel > 0").select("name", "shape", "offset", "numel", F.explode(F.sequence(F.floor(F.col("offset") / grain), F.floor((F.col("offset") + F.col("numel") - 1) / grain))).alias("grain"))
    placed = stream.select("pos", "x").withColumn("grain", F.floor(F.col("pos") / grain)).join(held, "grain").where("pos >= offset and pos < offset + numel")
    keys = ("name", "shape", "offset", "numel")
    slices = placed.groupBy(*keys, "grain").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    whole = slices.groupBy("name", "offset").agg(F.sum(F.size("v")).alias("held")).select(F.col("name").alias("_name"), F.col("offset").alias("_offset"), "held")
    full = slices.join(whole, (F.col("name") == F.col("_name")) & (F.col("offset") == F.col("_offset"))).where("held = numel")
    told = full.select(*keys, (F.col("v")[0]["pos"] - F.col("offset")).alias("first"), F.transform("v", lambda e: e["x"]).alias("values"))
    end = stream.agg((F.max("pos") + 1).alias("end"))  # one row
    empty = manifest.where("numel = 0").join(end, F.col("offset") < F.col("end")).select(*keys, F.lit(0).cast("long").alias("first"), F.array().cast("array<float>").alias("values"))
    return told.unionByName(empty)


def restored_arrays(slices: DataFrame) -> Iterator[tuple[str, np.ndarray]]:
    """(name, array of the tensor's shape) of restored slices, one tensor in memory at a time."""
    key, parts = None, []
    for row in slices.orderBy("offset", "name", "first").toLocalIterator():
        own = (row["name"], tuple(row["shape"]))
        if own != key and parts:
            yield key[0], np.concatenate(parts).reshape(key[1])
            parts = []
        key = own
        parts.append(np.array(row["values"], np.float32))
    if parts:
        yield key[0], np.concatenate(parts).reshape(key[1])
