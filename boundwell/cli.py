"""Command line: compress, decompress, verify."""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import replace

from pyspark.sql import SparkSession

from boundwell.config import CRITERIA, ERROR_MODES, MODES, Config, human, parse_size, power_label
from boundwell.operators import sizes
from boundwell.plans import compress as plans
from boundwell.sources import container, tensors


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="boundwell", description="Error-bounded compression of float streams on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("compress", "tensor file to a folder of chunks or a .wp container"), ("decompress", "chunks to a flat .npy file"), ("verify", "compare chunks with their source, value by value")):
        c = sub.add_parser(name, help=what)
        c.add_argument("source")
        c.add_argument("target", nargs="?" if name == "compress" else None)
        c.add_argument("-e", "--error-bound", type=float)
        c.add_argument("-w", "--window-size", type=parse_size, default=128 << 20)
        c.add_argument("-t", "--tuple-size", type=int, default=2)
        c.add_argument("-o", "--output-dir")
        c.add_argument("--mode", choices=MODES, default="cluster")
        c.add_argument("--error-mode", choices=ERROR_MODES, default="relative")
        c.add_argument("--k-start", type=int, default=64)
        c.add_argument("--max-k", type=int, default=1 << 24)
        c.add_argument("--k-criterion", choices=CRITERIA, default="size")
        c.add_argument("--min-k-gain", type=float, default=0.02)
        c.add_argument("--k-patience", type=int, default=2)
        c.add_argument("--kmeans-iters", type=int, default=25)
        c.add_argument("--zstd-level", type=int, default=3)
        c.add_argument("--seed", type=int, default=0)
        c.add_argument("--dtype", default="float32")
        c.add_argument("--limit-bytes", type=parse_size)
        c.add_argument("--json", action="store_true")
    return p


def config_of(a: argparse.Namespace) -> Config:
    return Config(1e-4 if a.error_bound is None else a.error_bound, a.error_mode, a.mode, a.window_size, a.tuple_size, a.k_start, a.max_k, a.k_criterion, a.min_k_gain, a.k_patience, a.kmeans_iters, zstd_level=a.zstd_level, seed=a.seed)


def _chunks(spark: SparkSession, path: str):
    return container.read_container(spark, path) if path.endswith(".wp") else plans.read_run(spark, path)


def run_report(chunks, cfg: Config, seconds: float) -> dict:
    """What a run is told by: run_stats, the k histogram, shares of the stored bytes, speed, and whether the bound holds."""
    row = sizes.run_stats(plans.stats(chunks)).first().asDict()
    parts = sum(row[p] for p in sizes.PARTS) or 1
    shares = {p.replace("_bytes", "_share"): 100 * row[p] / parts for p in sizes.PARTS}
    held = row["max_error"] is None or row["max_error"] <= cfg.error_bound
    histogram = {power_label(r.k): r.windows for r in sizes.k_histogram(chunks).collect()}
    return row | shares | {"k_histogram": histogram, "seconds": seconds, "mib_per_second": row["raw_bytes"] / max(seconds, 1e-9) / (1 << 20), "error_bound": cfg.error_bound, "held": held}


def report_lines(row: dict, target: str, cfg: Config) -> list[str]:
    """run_report for people."""
    shares = ", ".join(f"{p.split('_')[0]} {row[p.replace('_bytes', '_share')]:.2f}%" for p in sizes.PARTS)
    return [
        f"{target}: {row['n_values']} values in {row['windows']} windows of {human(cfg.window_bytes)}",
        f"clusters: {', '.join(f'{k} x {n}' for k, n in row['k_histogram'].items())}; occupied {row['min_occupied']} to {row['max_occupied']}",
        f"{human(row['raw_bytes'])} to {human(row['stored_bytes'])} ({row['ratio']:.3f}x, {row['bits_per_value']:.2f} bits a value)",
        f"of these {shares}; {row['n_outliers']} values verbatim",
        f"worst error {'unknown' if row['max_error'] is None else format(row['max_error'], '.3e')}, bound {cfg.error_bound:.3e}: {'HELD' if row['held'] else 'VIOLATED'}",
        f"{row['seconds']:.2f} s, {row['mib_per_second']:.1f} MiB/s",
    ]


def window_line(row) -> str:
    """One window of the stats for people."""
    return f"  window {row.w}: k {power_label(row.k)}, {row.n_values} values, {row.bits_per_value:.2f} bits a value, {row.n_outliers} verbatim, worst error {row.max_error:.3e}, mean {row.mean_error:.3e}, {row.trials} trials"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; verify gives 1 if a value is over the bound or has no counterpart, compress if residual mode misses the bound.

    decompress and verify go by the settings that the chunks carry; of the options only -e is heard, as another bound to verify against.
    """
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("boundwell").getOrCreate()
    if a.command == "compress":
        cfg = config_of(a)
        target = a.target or f"{(a.output_dir or '.').rstrip('/')}/{a.source.rstrip('/').rpartition('/')[2]}.chunks"
        began = time.time()
        chunks = plans.compress_file(spark, a.source, cfg, a.dtype, a.limit_bytes)
        if target.endswith(".wp"):
            # Compressed once, as a table beside the container, which has the errors and trials that a container doesn't store.
            plans.write_run(chunks, f"{target}.chunks")
            chunks = plans.read_run(spark, f"{target}.chunks")
            meta = {"error_bound": cfg.error_bound, "tuple_size": cfg.tuple_size, "window_size": cfg.window_bytes, "mode": cfg.mode, "error_mode": cfg.error_mode, "device": "cpu", "source": tensors_meta(a.source, a.dtype)}
            container.write_container(chunks, target, meta)
        else:
            plans.write_run(chunks, target, None if a.json else lambda row: print(window_line(row)))
            chunks = plans.read_run(spark, target)
        row = run_report(chunks, cfg, time.time() - began)
        print(json.dumps(row) if a.json else "\n".join(report_lines(row, target, cfg)))
        return int(cfg.mode == "residual" and not row["held"])
    chunks = _chunks(spark, a.source if a.command == "decompress" else a.target)
    if a.command == "decompress":
        n = plans.write_decoded(chunks, a.target)
        print(json.dumps({"n_values": n}) if a.json else f"{a.target}: {n} values")
        return 0
    known = plans.settings(chunks)
    bound = known.error_bound if a.error_bound is None else a.error_bound
    source = tensors.read_windows(spark, a.source, known.window_values or 1 << 25, a.dtype, a.limit_bytes)
    checked = plans.verify_chunks(None, chunks, replace(Config(), error_bound=bound, error_mode=known.error_mode or "relative", mode="residual"), source=source)
    row = checked.first().asDict()
    print(json.dumps(row) if a.json else f"{'PASS' if row['passed'] else 'FAIL'}: {row['n_values']} values, worst error {row['max_error']:.3e}, {row['violations']} over the bound, {row['unmatched']} places on one side only")
    return 0 if row["passed"] else 1


def tensors_meta(path: str, dtype: str) -> dict:
    found, size = tensors.manifest_of(path, dtype)
    return {"path": path, "total_values": sum(t.numel for t in found), "source_bytes": size, "tensors": [{"name": t.name, "dtype": t.dtype, "shape": list(t.shape), "offset": t.offset, "numel": t.numel, "itemsize": t.itemsize} for t in found]}


if __name__ == "__main__":
    sys.exit(main())
