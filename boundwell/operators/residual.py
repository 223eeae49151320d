"""Residual mode: a prediction plus a whole number of steps, in the value or in the log domain; and the byte planes of the codes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundwell.config import ESCAPE_BYTES
from boundwell.functions import scalar as S

#: Values of a window from which plane entropies are taken, at most about.
PLANE_SAMPLE = 1 << 21


def steps(rows: DataFrame, bound: float, relative: bool) -> DataFrame:
    """(w, step): the step of each window from the largest finite magnitude in its domain."""
    v = S.log_magnitude(F.col("x")) if relative else F.when(S.finite(F.col("x")), F.col("x").cast("double"))
    largest = rows.groupBy("w").agg(F.coalesce(F.max(F.abs(v)), F.lit(0.0)).alias("largest"))
    return largest.select("w", S.step_column(math.log1p(bound) if relative else bound, F.col("largest")).alias("step"))


def decoded(code: Column, pred: Column, step: Column, sign: Column | None) -> Column:
    """What a code decodes to; sign is given in the log domain."""
    value = S.reconstruct(code, pred, step)
    return value if sign is None else S.from_log(sign, value)


def first_codes(rows: DataFrame, bound: float, relative: bool) -> DataFrame:
    """rows (w, i, x, pred) with step, sign, code, z, xhat, err and bad, before a plane width is chosen. Codes that miss the bound are 0."""
    sign = S.sign(F.col("x")) if relative else None
    value = S.log_magnitude(F.col("x")) if relative else F.col("x")
    code = S.residual_code(value, F.col("pred"), F.col("step"))
    coded = rows.join(steps(rows, bound, relative), "w").withColumn("code0", code)
    xhat = decoded(F.col("code0"), F.col("pred"), F.col("step"), sign)
    err = S.relative_error(F.col("xhat"), F.col("x")) if relative else S.absolute_error(F.col("xhat"), F.col("x"))
    bad = (F.col("code0") == 0) | S.over(F.col("err"), bound)
    if relative:
        bad = bad | S.must_escape(F.col("x"))
    known = coded.withColumn("xhat", xhat).withColumn("err", err).withColumn("bad", bad)
    known = known.withColumn("code", F.when(F.col("bad"), F.lit(0)).otherwise(F.col("code0")))
    return known.withColumns({"z": S.zigzag(F.col("code")), "sign": S.sign(F.col("x"))}).drop("code0")


def plane_histogram(codes: DataFrame, n_values: int | None = None) -> DataFrame:
    """(w, plane, byte, n): counts of each byte in each of the four planes of z, from every stride-th value."""
    stride = max(1, (n_values or 0) // PLANE_SAMPLE)
    some = codes if stride == 1 else codes.where(F.col("i") % stride == 0)
    by_word = some.groupBy("w", "z").agg(F.count("*").alias("m"))
    bytes_ = by_word.select("w", "m", F.posexplode(S.split_planes(F.col("z"))).alias("plane", "byte"))
    return bytes_.groupBy("w", "plane", "byte").agg(F.sum("m").alias("n"))


def plane_entropy(histogram: DataFrame) -> DataFrame:
    """(w, plane, bits): zeroth-order entropy of each plane."""
    total = F.sum("n").over(Window.partitionBy("w", "plane"))
    bins = histogram.withColumn("part", S.entropy(F.col("n"), total))
    return bins.groupBy("w", "plane").agg(F.sum("part").alias("bits"))


def overflow(codes: DataFrame) -> DataFrame:
    """(w, n, over1, over2, over3): words that don't fit in so many planes."""
    return codes.groupBy("w").agg(F.count("*").alias("n"), *(F.count_if(F.col("z") >= 1 << 8 * k).alias(f"over{k}") for k in (1, 2, 3)))


def choose_width(codes: DataFrame, n_values: int | None = None) -> DataFrame:
    """(w, width, cost): the number of planes whose coded bytes and escapes cost least; the smallest of equals.

    One pass over the codes: words are counted first, all and those of the sample, and bytes and overflow come from the words.
    """
    stride = max(1, (n_values or 0) // PLANE_SAMPLE)
    words = codes.groupBy("w", "z").agg(F.count("*").alias("m"), F.count_if(F.col("i") % stride == 0).alias("s"))
    planes = words.select("w", "z", "m", "s", F.posexplode(S.split_planes(F.col("z"))).alias("plane", "byte"))
    beyond = F.when(F.col("plane") == 0, F.col("z") >= 1 << 8).when(F.col("plane") == 1, F.col("z") >= 1 << 16).when(F.col("plane") == 2, F.col("z") >= 1 << 24).otherwise(F.lit(False))
    bins = planes.groupBy("w", "plane", "byte").agg(F.sum("s").alias("s"), F.sum("m").alias("m"), F.coalesce(F.sum(F.when(beyond, F.col("m"))), F.lit(0)).alias("over"))
    some = F.count_if(F.col("s") > 0)
    bits = F.when(some <= 1, F.lit(0.0)).otherwise(F.log2(F.sum("s").cast("double")) - F.sum(F.when(F.col("s") > 0, F.col("s") * F.log2(F.col("s").cast("double")))) / F.sum("s"))
    each = bins.groupBy("w", "plane").agg(bits.alias("bits"), F.sum("m").alias("n"), F.sum("over").alias("over"))
    own = lambda c, p: F.max(F.when(F.col("plane") == p, F.col(c)))
    both = each.groupBy("w").agg(F.max("n").alias("n"), *(own("bits", p).alias(f"h{p}") for p in range(4)), *(own("over", p).alias(f"over{p + 1}") for p in range(3)))
    costs, sum_ = [], F.lit(0.0)
    for k in (1, 2, 3, 4):
        sum_ = sum_ + F.col(f"h{k - 1}") * F.col("n") / 8
        costs.append(F.struct((sum_ + ESCAPE_BYTES * F.col(f"over{k}") if k < 4 else sum_).alias("cost"), F.lit(k).alias("width")))
    best = both.select("w", F.array_min(F.array(*costs)).alias("best"))
    return best.select("w", "best.width", "best.cost")


def quantize(rows: DataFrame, bound: float, relative: bool = False, n_values: int | None = None) -> DataFrame:
    """(w, i, x, pred, step, sign, width, code, z, xhat, err, esc) of rows (w, i, x, pred): all values, coded or escaped.

    The check is done with the decoder's own arithmetic, so a coded value decodes within the bound by construction.
    """
    codes = first_codes(rows, bound, relative)
    wide = codes.join(choose_width(codes, n_values).select("w", "width"), "w")
    esc = F.col("bad") | (F.coalesce(F.col("z") >= S.plane_limit(F.col("width")), F.lit(False)))
    out = wide.withColumn("esc", esc)
    out = out.withColumn("code", F.when(F.col("esc"), F.lit(0)).otherwise(F.col("code"))).withColumn("z", S.zigzag(F.col("code")))
    return out.withColumn("err", F.when(F.col("esc"), F.lit(0.0)).otherwise(F.col("err"))).select("w", "i", "x", "pred", "step", "sign", "width", "code", "z", "xhat", "err", "esc")


def dequantize(codes: DataFrame, verbatim: DataFrame, relative: bool = False) -> DataFrame:
    """(w, i, x) from (w, i, z, pred, step, sign) and the escapes (w, i, x), which win."""
    value = decoded(S.unzigzag(F.col("z")), F.col("pred"), F.col("step"), F.col("sign") if relative else None)
    laid = codes.join(verbatim.select("w", "i", F.lit(True).alias("_esc"), F.col("x").alias("_x")), ["w", "i"], "left")
    return laid.select("w", "i", F.when(F.col("_esc"), F.col("_x")).otherwise(value).alias("x"))


def escape_deltas(verbatim: DataFrame) -> DataFrame:
    """(w, i, delta): each escape's distance from the one before, the first's from 0."""
    before = F.lag("i", 1, 0).over(Window.partitionBy("w").orderBy("i"))
    return verbatim.select("w", "i", (F.col("i") - before).alias("delta"))


def escape_places(deltas: DataFrame, order: str = "i") -> DataFrame:
    """(w, order, place): running sums of the distances, which are the places again."""
    total = F.sum("delta").over(Window.partitionBy("w").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return deltas.select("w", order, total.alias("place"))
