"""Cluster mode: a log-uniform codebook per window, so that every coded value is within a relative bound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundwell.functions import scalar as S

LEAST_SPAN = 1e-30


def first_k(k_start: int) -> int:
    """The power of two from which k doubles: at least 64 and at least k_start."""
    return 1 << max(6, (max(2, k_start) - 1).bit_length())


def cluster_count(span: Column, width: float, k_start: int, max_k: int) -> Column:
    """The first doubling of k whose cells are narrow enough, or that reaches max_k."""
    k = first_k(k_start)
    chosen = None
    while k < max_k:
        fits = ~(span / F.lit(float(k)) > width)
        chosen = F.when(fits, F.lit(k)) if chosen is None else chosen.when(fits, F.lit(k))
        k *= 2
    return (F.lit(k) if chosen is None else chosen.otherwise(F.lit(k))).cast("long")


def window_ends(rows: DataFrame) -> DataFrame:
    """(w, n, umin, umax) of every window; a window without a logarithm has umin = umax = 0."""
    u = F.when(~S.must_escape(F.col("x")), S.log_magnitude(F.col("x")))
    return rows.groupBy("w").agg(F.count("*").alias("n"), F.coalesce(F.min(u), F.lit(0.0)).alias("umin"), F.coalesce(F.max(u), F.lit(0.0)).alias("umax"))


def bound_params(ends: DataFrame, bounds: Sequence[float], k_start: int = 64, max_k: int = 1 << 24) -> DataFrame:
    """ends with bound, k and cellw: a row for each bound."""
    span = F.greatest(F.col("umax") - F.col("umin"), F.lit(LEAST_SPAN))
    each = F.array(*(F.struct(F.lit(float(b)).alias("bound"), cluster_count(span, S.cell_width(b), k_start, max_k).alias("k")) for b in bounds))
    wide = ends.select("w", "n", "umin", "umax", span.alias("span"), F.explode(each).alias("p"))
    return wide.select("w", "n", "umin", "umax", "p.bound", "p.k", (F.col("span") / F.col("p.k")).alias("cellw"))


def window_params(rows: DataFrame, bound: float, k_start: int = 64, max_k: int = 1 << 24) -> DataFrame:
    """(w, n, umin, umax, k, cellw) of every window."""
    return bound_params(window_ends(rows), [bound], k_start, max_k).drop("bound")


def encode_bounds(rows: DataFrame, bounds: Sequence[float], k_start: int = 64, max_k: int = 1 << 24) -> DataFrame:
    """(bound, w, i, x, k, n, sign, cell, c, xhat, rel, esc): every value's cell at each bound, what it decodes to, and whether it is stored verbatim.

    The windows' ends are one aggregate for all bounds. Windows meet their parameters by a plain equi-join: adaptive execution
    broadcasts them if they turn out small.
    """
    joined = rows.select("w", "i", "x").join(bound_params(window_ends(rows), bounds, k_start, max_k), "w")
    cells = joined.withColumn("cell", S.cell_of(S.log_magnitude(F.col("x")), F.col("umin"), F.col("cellw"), F.col("k")))
    coded = cells.withColumns({"c": S.cell_middle(F.col("cell"), F.col("umin"), F.col("cellw")), "sign": S.sign(F.col("x"))})
    decoded = coded.withColumn("xhat", S.from_log(F.col("sign"), F.col("c")))
    rel = S.relative_error(F.col("xhat"), F.col("x"))
    esc = S.must_escape(F.col("x")) | S.over(rel, F.col("bound"))
    out = decoded.withColumn("esc", esc).withColumn("rel", F.when(F.col("esc"), F.lit(0.0)).otherwise(rel))
    return out.select("bound", "w", "i", "x", "n", "k", "sign", "cell", "c", "xhat", "rel", "esc")


def encode(rows: DataFrame, bound: float, k_start: int = 64, max_k: int = 1 << 24) -> DataFrame:
    """encode_bounds at one bound, without its column."""
    return encode_bounds(rows, [bound], k_start, max_k).drop("bound")


def log_error(encoded: DataFrame) -> DataFrame:
    """(w, log_error, as_relative): the worst error of a coded value's logarithm in each window, and what it means as a relative error."""
    off = F.max(F.when(~F.col("esc"), F.abs(F.col("c").cast("double") - S.log_magnitude(F.col("x")))))
    worst = encoded.groupBy("w").agg(F.coalesce(off, F.lit(0.0)).alias("log_error"))
    return worst.withColumn("as_relative", S.log_as_relative(F.col("log_error")))


def codebook(encoded: DataFrame) -> DataFrame:
    """(w, label, cell, c, n): the occupied cells of each window, numbered in order. Escaped values keep a label."""
    cells = encoded.groupBy("w", "cell").agg(F.first("c").alias("c"), F.count("*").alias("n"))
    number = F.row_number().over(Window.partitionBy("w").orderBy("cell")) - 1
    return cells.select("w", number.alias("label"), "cell", "c", "n")


def labelled(encoded: DataFrame, book: DataFrame | None = None) -> DataFrame:
    """encoded with its label."""
    book = codebook(encoded) if book is None else book
    return encoded.join(book.select("w", "cell", "label"), ["w", "cell"])


def escapes(encoded: DataFrame) -> DataFrame:
    """(w, i, x) of the values that are stored verbatim."""
    return encoded.where("esc").select("w", "i", "x")


def decode(labels: DataFrame, book: DataFrame, verbatim: DataFrame | None = None) -> DataFrame:
    """(w, i, x) from (w, i, sign, label), the codebook (w, label, c) and the escapes, which win.

    Without a table of escapes the labels have them, as columns esc and x, and no value meets another.
    """
    looked = labels.join(book.select("w", "label", F.col("c").alias("_c")), ["w", "label"])
    if verbatim is None:
        laid = looked.withColumns({"_esc": F.col("esc"), "_x": F.col("x")})
    else:
        laid = looked.join(verbatim.select("w", "i", F.lit(True).alias("_esc"), F.col("x").alias("_x")), ["w", "i"], "left")
    return laid.select("w", "i", F.when(F.col("_esc"), F.col("_x")).otherwise(S.from_log(F.col("sign"), F.col("_c"))).alias("x"))


def window_stats(encoded: DataFrame, *keys: str) -> DataFrame:
    """(keys, w, n, k, occupied, n_escapes, max_error, mean_error) of each window, escapes counting 0."""
    by_cell = encoded.groupBy(*keys, "w", "cell").agg(
        F.count("*").alias("m"), F.first("k").alias("k"), F.count_if("esc").alias("e"), F.max("rel").alias("worst"), F.sum("rel").alias("total")
    )
    return by_cell.groupBy(*keys, "w").agg(
        F.sum("m").alias("n"), F.first("k").alias("k"), F.count("*").alias("occupied"), F.sum("e").alias("n_escapes"), F.max("worst").alias("max_error"), (F.sum("total") / F.sum("m")).alias("mean_error")
    )
