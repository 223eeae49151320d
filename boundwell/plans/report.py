"""Experiment rows over several settings, their storage and their report."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundwell.config import VALUE_BYTES, Config, power_label
from boundwell.operators import packing, sizes
from boundwell.plans.compress import compress, stats, sweep, verify_chunks
from boundwell.sources.tensors import exists, read_stream


def summary(swept: DataFrame) -> DataFrame:
    """One row for each bound of a sweep: windows, values, largest k, occupied cells, escapes, worst and mean error."""
    weighted = F.sum(F.col("mean_error") * F.col("n")) / F.sum("n")
    return swept.groupBy("bound").agg(
        F.count("*").alias("windows"), F.sum("n").alias("n_values"), F.max("k").alias("k"), F.max("occupied").alias("occupied"), F.sum("n_escapes").alias("n_outliers"), F.max("max_error").alias("max_error"), weighted.alias("mean_error")
    )


def sweep_summary(rows: DataFrame, bounds: Sequence[float]) -> DataFrame:
    return summary(sweep(rows, bounds))


def experiment(name: str, stream: DataFrame, cfg: Config, source_bytes: int | None = None) -> DataFrame:
    """One row: a run's sizes and its verification, value by value. source_bytes: size of the source, where its values are narrower or wider than floats.

    The run is made and checked here, and its chunks are released.
    """
    spark = stream.sparkSession
    chunks = compress(stream, cfg).persist()
    try:
        total = sizes.run_stats(stats(chunks)).drop("max_error").first().asDict()
        checked = verify_chunks(stream, chunks, cfg).select("max_error", "violations", "unmatched", "passed").first().asDict()
    finally:
        chunks.unpersist()
    row = {"name": name, "mode": cfg.mode, "error_mode": cfg.error_mode, "error_bound": cfg.error_bound} | total | checked
    row["source_bytes"] = row["n_values"] * VALUE_BYTES if source_bytes is None else source_bytes
    row["source_ratio"] = row["source_bytes"] / max(1, row["stored_bytes"])
    kinds = {str: "string", float: "double", bool: "boolean"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(type(v), 'long')}" for k, v in row.items()))


def experiments(stream: DataFrame, runs: dict[str, Config], source_bytes: int | None = None) -> DataFrame:
    """Rows of several runs over one stream."""
    return reduce(DataFrame.unionByName, (experiment(n, stream, c, source_bytes) for n, c in runs.items()))


#: Bounds of the group "bound".
BOUNDS = (1e-2, 1e-3, 1e-4, 1e-5, 1e-6)


def planned(models: dict[str, str], groups: Sequence[str] = ("models", "bound", "compare"), limit: int = 256 << 20, base: Config = Config()) -> list[tuple[str, str, Config, int | None]]:
    """(name, path, settings, bytes to read) of the runs of some groups: every model that exists, its first at several bounds, and its first in each mode."""
    there = {n: p for n, p in models.items() if exists(p)}
    if not there:
        return []
    one = next(iter(there.values()))
    of = {
        "models": [(f"model-{n}", p, base, None) for n, p in there.items()],
        "bound": [(f"bound-{b:.0e}", one, replace(base, error_bound=b), limit) for b in BOUNDS],
        "compare": [("method-cluster", one, base, limit), ("method-residual", one, replace(base, mode="residual"), limit), ("method-vq", one, replace(base, mode="vq", k_start=256, max_k=256), limit)],
    }
    return [run for g in groups for run in of[g]]


def run_planned(spark: SparkSession, plan: Sequence[tuple[str, str, Config, int | None]], dtype: str = "float32") -> Iterator[DataFrame]:
    """Each planned run's row, when it is done."""
    for name, path, cfg, limit in plan:
        yield experiment(name, read_stream(spark, path, dtype, limit), cfg)


def write_results(rows: DataFrame, path: str) -> None:
    """Append experiment rows as JSON lines."""
    rows.write.mode("append").json(path)


def load_results(spark: SparkSession, path: str, skip: Sequence[str] = ("summary.json", "lossless.json")) -> DataFrame:
    """JSON results, one object a line or a file, with the file that each came from; files named in skip are left out."""
    rows = spark.read.option("multiLine", path.endswith("*.json")).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.where(~F.col("file").isin(list(skip)))


def with_lossless(results: DataFrame, lossless: DataFrame) -> DataFrame:
    """Results beside the lossless sizes (name, raw_bytes, plain_bytes, planes_bytes) of the same name; those without any stay."""
    ratios = lossless.select("name", (F.col("raw_bytes") / F.greatest("plain_bytes", F.lit(1))).alias("lossless_ratio"), (F.col("raw_bytes") / F.greatest("planes_bytes", F.lit(1))).alias("planes_ratio"))
    return results.join(ratios, "name", "left")


def markdown(rows: Sequence[dict], columns: Sequence[str]) -> str:
    """A Markdown table; k is shown as a power of two, floats with four digits."""

    def cell(name: str, value) -> str:
        if value is None:
            return "-"
        return power_label(value) if name == "k" else f"{value:.4g}" if isinstance(value, float) else str(value)

    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(c, r.get(c)) for c in columns) + " |" for r in rows])


def splice(text: str, marker: str, body: str) -> str:
    """text with body between the marker's start and end comments; added at the end where they are missing."""
    begin, end = f"<!-- {marker} -->", f"<!-- /{marker} -->"
    block = f"{begin}\n{body}\n{end}"
    if begin in text and end in text.split(begin, 1)[1]:
        before, rest = text.split(begin, 1)
        return before + block + rest.split(end, 1)[1]
    return f"{text.rstrip()}\n\n{block}\n"


def iter_windows(chunks: DataFrame) -> Iterator[np.ndarray]:
    """The decoded windows one after another, each fetched when it is asked for."""
    for row in chunks.orderBy("w").toLocalIterator():
        yield packing.unpack_window(row.asDict())


def plan_concurrency(budget: int, window: int, most: int) -> int:
    """Windows that may be worked on at a time: what the memory budget allows, at least one and at most `most`."""
    return max(1, min(most, budget // max(1, window)))


def window_memory(values: int, k: int, tuple_size: int) -> int:
    """Bytes that packing a window takes at its peak: values, labels, signs, escapes and codebook in columns, and their compressed copies."""
    return values * (VALUE_BYTES + 8 + 4 + 1 + 1) * 2 + k * tuple_size * 8
