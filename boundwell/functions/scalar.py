"""Column builders: everything here is a JVM expression that code generation covers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from boundwell.config import CODE_MAX

INF = float("inf")
#: A plain relative error divides by this at least.
TINY = 1e-300
#: The guard band of a step: a part of the bound, the value's own float spacing, and at most this part of the bound.
GUARD_PART, GUARD_ULP, GUARD_MOST = 1e-4, 2.0**-22, 0.05


def widen(x: Column) -> Column:
    """Any numeric or boolean column as a 32-bit float; doubles and large integers are rounded."""
    return x.cast("float")


def finite(x: Column) -> Column:
    """Neither NaN (greater than infinity in Spark's order) nor infinite."""
    return F.abs(x) < F.lit(INF)


def must_escape(x: Column) -> Column:
    """Zero and non-finite values have no logarithm."""
    return (x == 0) | ~finite(x)


def log_magnitude(x: Column) -> Column:
    """log|x| in double precision; 0 where x must escape."""
    return F.when(must_escape(x), F.lit(0.0)).otherwise(F.ln(F.abs(x.cast("double"))))


def sign(x: Column) -> Column:
    return F.when(x < 0, F.lit(-1)).otherwise(F.lit(1))


def cell_width(bound: float) -> float:
    """Widest log cell whose middle is within a relative bound of all of it."""
    return 2 * math.log1p(bound)


def cell_of(u: Column, low: Column, width: Column, k: Column) -> Column:
    """Number of the equal-width cell that u falls in, held to 0 .. k - 1."""
    return F.least(F.greatest(F.floor((u - low) / width), F.lit(0)), k - 1).cast("long")


def cell_middle(cell: Column, low: Column, width: Column) -> Column:
    return (low + (cell + 0.5) * width).cast("float")


def from_log(sign_: Column, c: Column) -> Column:
    """The float that a sign and a log magnitude stand for: the one decoder, used for checking and for decoding."""
    return (sign_ * F.exp(c.cast("double"))).cast("float")


def relative_error(decoded: Column, x: Column) -> Column:
    x = x.cast("double")
    return F.abs(decoded.cast("double") - x) / F.greatest(F.abs(x), F.lit(TINY))


def absolute_error(decoded: Column, x: Column) -> Column:
    return F.abs(decoded.cast("double") - x.cast("double"))


def log_as_relative(error: Column) -> Column:
    """An error of a logarithm as the relative error that it stands for."""
    return F.expm1(error)


def over(error: Column, bound: float | Column) -> Column:
    """Strictly over the bound, or not a number."""
    return F.isnan(error) | (error > bound)


def step_column(bound: float, largest: Column) -> Column:
    """Width of a residual step: twice the bound less a guard for float rounding at magnitudes up to `largest`."""
    guard = F.least(F.greatest(F.lit(bound * GUARD_PART), largest * GUARD_ULP), F.lit(GUARD_MOST * bound))
    return 2 * (F.lit(bound) - guard)


def step_value(bound: float, largest: float = 0.0) -> float:
    return 2 * (bound - min(max(bound * GUARD_PART, largest * GUARD_ULP), GUARD_MOST * bound))


def residual_code(value: Column, prediction: Column, step: Column) -> Column:
    """Code of the rounded residual: 0 is the escape, so codes from 0 up move by one; half goes to even."""
    q = F.rint((value.cast("double") - prediction.cast("double")) / step)
    bad = F.isnan(q) | (q < -CODE_MAX) | (q > CODE_MAX - 1)
    safe = F.when(bad, F.lit(0.0)).otherwise(q).cast("int")
    return F.when(bad, F.lit(0)).when(safe >= 0, safe + 1).otherwise(safe)


def reconstruct(code: Column, prediction: Column, step: Column) -> Column:
    """What a residual code decodes to, in float arithmetic."""
    steps = F.when(code > 0, code - 1).otherwise(code).cast("float")
    return prediction.cast("float") + steps * step.cast("float")


def zigzag(code: Column) -> Column:
    """Small magnitudes to small non-negative words."""
    return F.shiftleft(code, 1).bitwiseXOR(F.shiftright(code, 31)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1))).cast("int")


def planes_needed(largest: Column) -> Column:
    """Bytes that words up to `largest` need, 1 to 4."""
    return F.when(largest < 1 << 8, 1).when(largest < 1 << 16, 2).when(largest < 1 << 24, 3).otherwise(4)


def plane_limit(planes: Column) -> Column:
    """The first word that doesn't fit in so many planes; null for four, which hold all."""
    return F.when(planes == 1, F.lit(1 << 8)).when(planes == 2, F.lit(1 << 16)).when(planes == 3, F.lit(1 << 24)).cast("long")


def plane(z: Column, i: int) -> Column:
    return F.shiftright(z, 8 * i).bitwiseAND(F.lit(255)).cast("int")


def split_planes(z: Column, n: int = 4) -> Column:
    return F.array(*(plane(z, i) for i in range(n)))


def join_planes(planes: Column) -> Column:
    """The word whose bytes, lowest first, are the planes."""
    return F.aggregate(F.reverse(planes), F.lit(0).cast("long"), lambda word, b: F.shiftleft(word, 8).bitwiseOR(b.cast("long")))


def label_bytes(k: Column) -> Column:
    """Bytes of the smallest unsigned type for k labels."""
    return F.when(k <= 1 << 8, 1).when(k <= 1 << 16, 2).otherwise(4)


def bits_per_value(stored: Column, n: Column) -> Column:
    return 8 * stored / F.greatest(n, F.lit(1))


def ratio(raw: Column, stored: Column) -> Column:
    return raw / F.greatest(stored, F.lit(1))


def entropy(n: Column, total: Column) -> Column:
    """A bin's part of the entropy in bits; the sum over the bins is the entropy."""
    p = n / total
    return -p * F.log2(p)
