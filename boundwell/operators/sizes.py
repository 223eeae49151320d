"""Entropies, size estimates and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundwell.config import ESCAPE_BYTES, VALUE_BYTES
from boundwell.functions import scalar as S

#: Codes that the estimate of a trial tells apart, in either direction, and the values that it looks at, at most about.
CODE_RANGE = 1 << 15
CODE_SAMPLE = 1 << 21


def entropy_by(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, bits, bins, n): zeroth-order entropy of a column. Bins are counted first, so no group's rows are gathered."""
    bins = rows.groupBy(*keys, value).agg(F.count("*").alias("m"))
    # sum(-p log2 p) = log2(n) - sum(m log2 m) / n, which needs one pass over the bins.
    both = bins.groupBy(*keys).agg(F.sum("m").alias("n"), F.count("*").alias("bins"), F.sum(F.col("m") * F.log2(F.col("m").cast("double"))).alias("s"))
    bits = F.when(F.col("bins") <= 1, F.lit(0.0)).otherwise(F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n"))
    return both.select(*keys, bits.alias("bits"), "bins", "n")


def clamped_code(x, c, step: float):
    """Residual code for an estimate: rounded, NaN as 0, held to CODE_RANGE."""
    q = F.rint((x.cast("double") - c.cast("double")) / F.lit(step))
    return F.least(F.greatest(F.nanvl(q, F.lit(0.0)), F.lit(float(-CODE_RANGE))), F.lit(float(CODE_RANGE))).cast("int")


def estimate_bytes(label_bits, n_tuples, code_bits, n_values, k, tuple_size: int):
    """Bytes of labels, residual codes and codebook, as an expression."""
    return F.floor((n_tuples * label_bits + n_values * code_bits) / 8) + VALUE_BYTES * k * tuple_size


def trial_cost(assigned: DataFrame, step: float, k: int, tuple_size: int) -> DataFrame:
    """One row (est_bytes, label_bits, code_bits, max_error, mean_error) for an assignment (label, x0.., c0..) of tuples."""
    lanes = F.array(*(F.struct(F.col(f"v{j}").alias("x"), F.col(f"c{j}").alias("c")) for j in range(tuple_size)))
    values = assigned.select(F.explode(lanes).alias("e")).select(clamped_code(F.col("e.x"), F.col("e.c"), step).alias("code"), S.absolute_error(F.col("e.c"), F.col("e.x")).alias("err"))
    labels = entropy_by(assigned, "label").select(F.col("bits").alias("label_bits"), F.col("n").alias("n_tuples"))
    codes = entropy_by(values, "code").select(F.col("bits").alias("code_bits"), F.col("n").alias("n_values"))
    errors = values.agg(F.max("err").alias("max_error"), F.avg("err").alias("mean_error"))
    one = labels.join(codes, F.lit(True)).join(errors, F.lit(True))  # three one-row tables
    return one.select(estimate_bytes(F.col("label_bits"), F.col("n_tuples"), F.col("code_bits"), F.col("n_values"), F.lit(k), tuple_size).cast("long").alias("est_bytes"), "label_bits", "code_bits", "max_error", "mean_error")


#: Byte counts of a packed window.
PARTS = ("codebook_bytes", "label_bytes", "code_bytes", "outlier_bytes")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """chunks with raw_bytes, stored_bytes, ratio and bits_per_value; needs n_values and PARTS."""
    stored = sum((F.col(p) for p in PARTS[1:]), F.col(PARTS[0]))
    out = chunks.withColumns({"raw_bytes": F.col("n_values") * VALUE_BYTES, "stored_bytes": stored})
    return out.withColumns({"ratio": S.ratio(F.col("raw_bytes"), F.col("stored_bytes")), "bits_per_value": S.bits_per_value(F.col("stored_bytes"), F.col("n_values"))})


def shares(stats: DataFrame) -> DataFrame:
    """stats with the percentage that each of PARTS has of the stored bytes."""
    return stats.withColumns({p.replace("_bytes", "_share"): 100 * F.col(p) / F.greatest("stored_bytes", F.lit(1)) for p in PARTS})


def run_stats(stats: DataFrame) -> DataFrame:
    """One row over all windows of chunk_stats: sums, worst error, ratio, bits per value and the range of occupied clusters."""
    total = stats.agg(
        F.count("*").alias("windows"),
        F.coalesce(F.sum("n_values"), F.lit(0)).alias("n_values"),
        F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"),
        F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("stored_bytes"),
        *(F.coalesce(F.sum(p), F.lit(0)).alias(p) for p in PARTS),
        F.coalesce(F.sum("n_outliers"), F.lit(0)).alias("n_outliers"),
        F.max(F.when(~F.isnan("max_error"), F.col("max_error"))).alias("max_error"),
        F.min("occupied").alias("min_occupied"),
        F.max("occupied").alias("max_occupied"),
    )
    return total.withColumns({"ratio": S.ratio(F.col("raw_bytes"), F.col("stored_bytes")), "bits_per_value": S.bits_per_value(F.col("stored_bytes"), F.col("n_values"))})


def k_histogram(stats: DataFrame) -> DataFrame:
    """(k, windows), in order of k."""
    return stats.groupBy("k").agg(F.count("*").alias("windows")).orderBy("k")


def escape_bytes(n):
    return n * ESCAPE_BYTES
