"""The engine's queries over a folder of test tables, and the SQL that they must agree with.

The weight stream is `embeddings` end to end: 64 values a vector, windows of 8192.
"""

from __future__ import annotations

import contextlib
import io
import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundwell.config import CODE_MAX, VALUE_BYTES, Config, human, parse_size
from boundwell.functions import scalar as S
from boundwell.operators import blocks, cluster, kmeans, packing, residual, sizes, stream, verify
from boundwell.plans import compress as plans
from boundwell.plans import report
from boundwell.shared import scratch
from boundwell.sources import container, tensors

DIM, VPW, EB = 64, 8192, 1e-4
BOUNDS = (1e-2, 1e-3, 1e-4, 1e-5, 1e-6)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(spark, sf_dir) -> DataFrame:
    return stream.flat_arrays(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DIM)


def rows_of(spark, sf_dir) -> DataFrame:
    return stream.windowed(flat(spark, sf_dir), VPW)


def events(spark, sf_dir) -> DataFrame:
    return stream.windowed(stream.flat_column(_table(spark, sf_dir, "events"), "event_id", "value"), VPW)


def zeros(spark, sf_dir) -> DataFrame:
    """The weight stream with a zero at every seventh place."""
    holed = flat(spark, sf_dir).withColumn("x", F.when(F.col("pos") % 7 == 0, F.lit(0.0).cast("float")).otherwise(F.col("x")))
    return stream.windowed(holed, VPW)


def encoded(spark, sf_dir, source=rows_of, bound: float = EB) -> DataFrame:
    return cluster.encode(source(spark, sf_dir), bound)


def with_prediction(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pred", F.lit(0.0).cast("float"))


def pairs(spark, sf_dir) -> DataFrame:
    return stream.tuples(rows_of(spark, sf_dir), 2)


#: Sixteen fixed centroids on a grid.
GRID = [(0.08 * (k % 4) - 0.12, 0.08 * (k // 4) - 0.12) for k in range(16)]
#: The same, and one that no tuple is near.
GRID_AND_FAR = [*GRID, (9.0, 9.0)]


def q_flat_stream(spark, sf_dir):
    return flat(spark, sf_dir)


def q_count_windows(spark, sf_dir):
    return rows_of(spark, sf_dir).groupBy("w").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))


def q_tail_window(spark, sf_dir):
    counts = rows_of(spark, sf_dir).groupBy("w").agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("n", "w").alias("tail"), F.count("*").alias("windows"))


def q_limit_prefix(spark, sf_dir):
    return stream.limit_values(flat(spark, sf_dir), 4000)


def _length(values: DataFrame) -> int:
    """Values of a stream, by its last place."""
    return values.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]


def q_concat_whole(spark, sf_dir):
    """The vectors and the events end to end, with lengths taken from the data."""
    both = [flat(spark, sf_dir), stream.flat_column(_table(spark, sf_dir, "events"), "event_id", "value")]
    return stream.concat([(s, _length(s)) for s in both])


def q_widen(spark, sf_dir):
    return stream.flat_column(_table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice")


def q_widen_int(spark, sf_dir):
    return stream.flat_column(_table(spark, sf_dir, "part"), "p_partkey", "p_size")


def q_log_ends(spark, sf_dir):
    return cluster.window_params(rows_of(spark, sf_dir), EB).select("w", "n", F.col("umin").cast("float").alias("umin"), F.col("umax").cast("float").alias("umax"))


def q_log_ends_events(spark, sf_dir):
    return cluster.window_params(events(spark, sf_dir), EB).select("w", "n", F.col("umin").cast("float").alias("umin"), F.col("umax").cast("float").alias("umax"))


def q_k_by_window(spark, sf_dir):
    return cluster.window_params(rows_of(spark, sf_dir), EB).select("w", "k")


def q_k_histogram(spark, sf_dir):
    return sizes.k_histogram(cluster.window_params(rows_of(spark, sf_dir), EB))


def q_cluster_labels(spark, sf_dir):
    return cluster.labelled(encoded(spark, sf_dir)).select("w", "i", "cell", "label")


def q_cluster_codebook(spark, sf_dir):
    return cluster.codebook(encoded(spark, sf_dir)).select("w", "label", "cell", "c", "n")


def q_cluster_decode(spark, sf_dir):
    e = encoded(spark, sf_dir)
    book = cluster.codebook(e)
    return cluster.decode(cluster.labelled(e, book), book)


def _stats(e: DataFrame) -> DataFrame:
    return cluster.window_stats(e).select("w", "n", "k", "occupied", "n_escapes", F.round("max_error", 9).alias("max_error"), F.round("mean_error", 9).alias("mean_error"))


def q_cluster_stats(spark, sf_dir):
    return _stats(encoded(spark, sf_dir))


def q_cluster_stats_events(spark, sf_dir):
    return _stats(encoded(spark, sf_dir, events))


def q_cluster_zeros(spark, sf_dir):
    return _stats(encoded(spark, sf_dir, zeros))


def q_escape_overlay(spark, sf_dir):
    e = encoded(spark, sf_dir, zeros)
    book = cluster.codebook(e)
    return cluster.decode(cluster.labelled(e, book), book, cluster.escapes(e))


def q_escape_zeros(spark, sf_dir):
    """Escapes by column value: line items have no short key, so this is order-free."""
    d = _table(spark, sf_dir, "lineitem").select(F.col("l_discount").cast("float").alias("x"))
    return d.groupBy(S.must_escape(F.col("x")).alias("esc")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


def q_bound_sweep(spark, sf_dir):
    exponent = F.round(-F.log10("bound")).cast("int").alias("exponent")
    return plans.sweep(rows_of(spark, sf_dir), BOUNDS).select(exponent, "w", "k", "occupied", "n_escapes")


def q_log_error(spark, sf_dir):
    return cluster.log_error(encoded(spark, sf_dir)).select("w", F.round("log_error", 9).alias("log_error"), F.round("as_relative", 9).alias("as_relative"))


def q_cluster_verify(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    decoded = q_cluster_decode(spark, sf_dir)
    return verify.verdict(verify.compare(rows, decoded), EB).withColumn("max_error", F.round("max_error", 9))


def q_unmatched(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    return verify.unmatched(rows, rows.where("i % 1000 <> 5"))


def q_sign_bytes(spark, sf_dir):
    return stream.pack_signs(rows_of(spark, sf_dir))


def _residual(spark, sf_dir, relative: bool, source=rows_of) -> DataFrame:
    return residual.quantize(with_prediction(source(spark, sf_dir)), 1e-3 if relative else EB, relative)


def q_resid_abs_codes(spark, sf_dir):
    return _residual(spark, sf_dir, False).select("w", "i", "code", "z", "xhat", "esc")


def q_resid_rel_codes(spark, sf_dir):
    return _residual(spark, sf_dir, True).select("w", "i", "code", "z", "xhat", "esc")


def _residual_summary(r: DataFrame) -> DataFrame:
    return r.groupBy("w").agg(F.count("*").alias("n"), F.first("width").alias("width"), F.count_if("esc").alias("n_escapes"), F.round(F.max("err"), 9).alias("max_error"))


def q_resid_abs_stats(spark, sf_dir):
    return _residual_summary(_residual(spark, sf_dir, False))


def q_resid_rel_stats(spark, sf_dir):
    return _residual_summary(_residual(spark, sf_dir, True, zeros))


def q_resid_verify(spark, sf_dir):
    r = _residual(spark, sf_dir, False, zeros)
    back = residual.dequantize(r, r.where("esc").select("w", "i", "x"))
    return verify.verdict(verify.compare(zeros(spark, sf_dir), back, False), EB).withColumn("max_error", F.round("max_error", 9))


def codes(spark, sf_dir) -> DataFrame:
    return residual.first_codes(with_prediction(rows_of(spark, sf_dir)), EB, False)


def q_zigzag(spark, sf_dir):
    return codes(spark, sf_dir).select("w", "i", "code", "z", S.unzigzag(F.col("z")).alias("back"))


def q_plane_split(spark, sf_dir):
    z = codes(spark, sf_dir)
    return z.select("w", "i", *(S.plane(F.col("z"), p).alias(f"p{p}") for p in range(4)), S.join_planes(S.split_planes(F.col("z"))).alias("joined"))


def q_planes_needed(spark, sf_dir):
    return codes(spark, sf_dir).groupBy("w").agg(F.max("z").alias("top")).select("w", S.planes_needed(F.col("top")).alias("planes"), S.plane_limit(S.planes_needed(F.col("top"))).alias("limit"))


def q_plane_histogram(spark, sf_dir):
    return residual.plane_histogram(codes(spark, sf_dir))


def q_plane_entropy(spark, sf_dir):
    return residual.plane_entropy(residual.plane_histogram(codes(spark, sf_dir))).select("w", "plane", (F.round("bits", 6) + 0.0).alias("bits"))


def q_choose_width(spark, sf_dir):
    return residual.choose_width(codes(spark, sf_dir)).select("w", "width", F.round("cost", 3).alias("cost"))


def q_label_entropy(spark, sf_dir):
    return sizes.entropy_by(encoded(spark, sf_dir), "cell", "w").select("w", F.round("bits", 6).alias("bits"), "bins", "n")


def q_label_width(spark, sf_dir):
    return sizes.entropy_by(encoded(spark, sf_dir), "cell", "w").select("w", S.label_bytes(F.col("bins")).alias("label_bytes"))


def q_est_bytes(spark, sf_dir):
    cost = sizes.trial_cost(kmeans.assign(pairs(spark, sf_dir), GRID), S.step_value(EB), len(GRID), 2)
    return cost.select("est_bytes", F.round("label_bits", 6).alias("label_bits"), F.round("code_bits", 6).alias("code_bits"), F.round("max_error", 9).alias("max_error"), F.round("mean_error", 9).alias("mean_error"))


def q_escape_delta(spark, sf_dir):
    return residual.escape_deltas(cluster.escapes(encoded(spark, sf_dir, zeros)))


def q_escape_cumsum(spark, sf_dir):
    return residual.escape_places(residual.escape_deltas(cluster.escapes(encoded(spark, sf_dir, zeros))))


def q_tuples2(spark, sf_dir):
    return pairs(spark, sf_dir)


def q_tuples3(spark, sf_dir):
    return stream.tuples(rows_of(spark, sf_dir), 3)


def q_nearest_centroid(spark, sf_dir):
    return kmeans.assign(pairs(spark, sf_dir), GRID).select("w", "t", "label", F.round("dist", 9).alias("dist"))


def q_lloyd_step(spark, sf_dir):
    return kmeans.update(kmeans.assign(pairs(spark, sf_dir), GRID), ["v0", "v1"]).select("label", "n", F.round("m0", 6).alias("m0"), F.round("m1", 6).alias("m1"))


def q_lloyd_steps(spark, sf_dir, times: int = 5):
    rows, centroids = pairs(spark, sf_dir), GRID
    for _ in range(times):
        centroids, _ = kmeans.lloyd_step(rows, centroids, ("w", "t"))
    return kmeans.assign(rows, centroids).groupBy("label").agg(F.count("*").alias("n"), F.round(F.first("c0"), 6).alias("c0"), F.round(F.first("c1"), 6).alias("c1"))


def q_empty_clusters(spark, sf_dir):
    return kmeans.empty_clusters(kmeans.assign(pairs(spark, sf_dir), GRID_AND_FAR), len(GRID_AND_FAR))


def q_worst_fit(spark, sf_dir):
    return kmeans.worst_fitting(kmeans.assign(pairs(spark, sf_dir), GRID), 10, ("w", "t")).select("w", "t", "v0", "v1", "label")


def q_strided_sample(spark, sf_dir):
    return stream.every(rows_of(spark, sf_dir), F.col("i"), VPW, 1000).select("w", "i", "x")


def q_vq_error(spark, sf_dir):
    near = kmeans.assign(pairs(spark, sf_dir), GRID)
    worst = F.greatest(*(S.absolute_error(F.col(f"c{j}"), F.col(f"v{j}")) for j in (0, 1)))
    return near.groupBy("w").agg(F.round(F.max(worst), 9).alias("max_error"))


def _manifest(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), F.array(F.lit(DIM)).alias("shape"), (F.col("vec_id") * DIM).alias("offset"), F.lit(DIM).alias("numel"))


def q_restore_whole(spark, sf_dir):
    """Every tensor of the stream but the last, which lacks the stream's last value and so is left out."""
    values = flat(spark, sf_dir)
    whole = stream.restore(values.where(F.col("pos") < _length(values) - 1), _manifest(spark, sf_dir))
    return whole.select("name", "offset", "first", F.posexplode("values").alias("at", "x")).select("name", "offset", (F.col("first") + F.col("at")).cast("int").alias("place"), "x")


def q_run_stats(spark, sf_dir):
    """Modelled bytes of cluster mode: labels at their width, codebook, signs and escapes, without a lossless layer."""
    s = cluster.window_stats(encoded(spark, sf_dir, zeros))
    parts = s.select(
        "w", "k", "occupied", "max_error", F.col("n").alias("n_values"), F.col("n_escapes").alias("n_outliers"), (F.col("occupied") * 4).alias("codebook_bytes"), (F.col("n") * S.label_bytes(F.col("occupied"))).alias("label_bytes"), F.lit(0).cast("long").alias("code_bytes"), (F.ceil(F.col("n") / 8) + F.col("n_escapes") * 8).alias("outlier_bytes")
    )
    total = sizes.run_stats(sizes.chunk_stats(parts))
    return total.withColumns({c: F.round(c, 9) for c in ("max_error", "ratio", "bits_per_value")})


def q_experiment_summary(spark, sf_dir):
    s = report.sweep_summary(rows_of(spark, sf_dir), BOUNDS)
    return s.select(F.round(-F.log10("bound")).cast("int").alias("exponent"), "windows", "n_values", "k", "occupied", "n_outliers", F.round("max_error", 9).alias("max_error"), F.round("mean_error", 9).alias("mean_error"))


def _positions(rows: DataFrame) -> DataFrame:
    return rows.select((F.col("w") * VPW + F.col("i")).alias("pos"), "x")


def _run(mode: str = "cluster", error_mode: str = "relative", **more) -> Config:
    """Settings of the test runs: windows of VPW values."""
    return Config(**{"error_bound": EB, "error_mode": error_mode, "mode": mode, "window_bytes": VPW * VALUE_BYTES} | more)


def q_pack_roundtrip(spark, sf_dir):
    """Pack and unpack give the decoded stream."""
    return packing.unpack(plans.compress(_positions(zeros(spark, sf_dir)), _run()))


def q_pack_residual_roundtrip(spark, sf_dir):
    values = _positions(zeros(spark, sf_dir))
    chunks = plans.compress(values, _run("residual", "absolute", tuple_size=1, k_start=1, max_k=1))
    return plans.verify_chunks(values, chunks).select("n_values", "n_windows", "violations", "passed")


def gappy(spark, sf_dir) -> DataFrame:
    """The weight stream without every fifth value, with the null of every eleventh left to the reader, and with far gaps."""
    values = flat(spark, sf_dir).where("pos % 5 <> 3").withColumn("x", F.when(F.col("pos") % 11 != 0, F.col("x")))
    return values.withColumn("pos", F.col("pos") + 3 * VPW * F.floor(F.col("pos") / 4096))


def q_compress_roundtrip(spark, sf_dir):
    """A stream with gaps and nulls, compressed and decompressed: values and places; residual mode decodes within the bound, so values are told by whether they are."""
    values = gappy(spark, sf_dir)
    back = plans.decompress(plans.compress(values, _run("residual", "absolute", k_start=4, max_k=4, kmeans_iters=3)))
    both = back.withColumnRenamed("x", "y").join(values, "pos")
    return both.select("pos", "x", (F.abs(F.col("y").cast("double") - F.col("x").cast("double")) <= EB).alias("held"))


def q_verify_run(spark, sf_dir):
    """Verification of whole runs: one that holds, one of which a window is missing, one that lacks values, one with a changed codebook, and one with values that the source lacks."""
    values = gappy(spark, sf_dir)
    chunks = plans.compress(values, _run())
    runs = {
        "whole": (values, chunks),
        "window lost": (values, chunks.where("w <> 3")),
        "values lost": (values, plans.compress(values.where("pos % 7 <> 1"), _run())),
        "other values": (values.withColumn("x", F.col("x") * 2), chunks),
        "source lacks": (values.where("pos % 7 <> 1"), chunks),
    }
    out = [plans.verify_chunks(v, c).select(F.lit(n).alias("run"), "n_values", "violations", "unmatched", "passed") for n, (v, c) in runs.items()]
    return reduce(DataFrame.unionByName, out)


def q_vq_chunks(spark, sf_dir):
    """Shape of vq chunks: a label for each tuple of two, four centroids of two values, no codes, signs or escapes."""
    chunks = plans.compress(flat(spark, sf_dir), _run("vq", "absolute", k_start=4, max_k=4, kmeans_iters=2))
    return chunks.select("w", "mode", "k", "tuple_size", "n_values", F.length("centroids").alias("centroid_bytes"), F.size("code_plane_blobs").alias("planes"), F.length("sign_blob").alias("sign_bytes"), "n_outliers", "step", "window_values")


def q_residual_tuples(spark, sf_dir):
    """Residual chunks over tuples of three, by window: settings, and that every value holds."""
    values = flat(spark, sf_dir)
    chunks = plans.compress(values, _run("residual", "relative", tuple_size=3, k_start=4, max_k=4, kmeans_iters=2))
    held = chunks.select("w", "k", "tuple_size", "n_values", F.length("centroids").alias("centroid_bytes"), (F.col("max_error") <= EB).alias("held"), "error_bound", "window_values")
    worst = verify.check_windows(blocks.blocks(values, VPW), chunks, True, EB).select(F.col("w").alias("_w"), "bad", "unmatched")
    return held.join(worst, F.col("w") == F.col("_w")).drop("_w")


def q_window_report(spark, sf_dir):
    """The report of each window of a cluster run."""
    told = plans.stats(plans.compress(flat(spark, sf_dir), _run()))
    whole = F.round(F.col("codebook_share") + F.col("label_share") + F.col("code_share") + F.col("outlier_share"), 6)
    return told.select("w", "mode", "occupied", "n_values", "raw_bytes", "codebook_bytes", "n_outliers", F.round("max_error", 9).alias("max_error"), F.round("mean_error", 9).alias("mean_error"), "trials", whole.alias("share"))


def _folder(spark, kind: str) -> str:
    """A new folder in the shared one, for the files that a query writes and reads."""
    path = scratch(spark, f"query-{kind}")
    where = re.sub("^file:/+", "/", path)
    tensors.make_folder(where)
    return where


def _filed(spark, sf_dir, kind: str) -> str:
    """The weight stream as a folder of files of VPW values."""
    path = _folder(spark, kind)
    stream_of = flat(spark, sf_dir)
    tensors.write_files(stream_of, path, VPW, kind).write.format("noop").mode("overwrite").save()
    return path


def q_read_npy(spark, sf_dir):
    return tensors.read_stream(spark, _filed(spark, sf_dir, "npy")).select("pos", "x")


def q_read_safetensors(spark, sf_dir):
    return tensors.read_stream(spark, _filed(spark, sf_dir, "safetensors")).select("name", "pos", "x")


def q_read_raw(spark, sf_dir):
    return tensors.read_stream(spark, _filed(spark, sf_dir, "bin"), "<f4").select("pos", "x")


def q_read_windows(spark, sf_dir):
    """Windows that don't fall on the files' edges, as blocks."""
    found = tensors.read_windows(spark, _filed(spark, sf_dir, "npy"), 5000)
    return found.select("w", F.lit(0).cast("long").alias("zero"), "first", F.length("data").alias("bytes")).groupBy("w").agg(F.min("first").alias("first"), F.sum("bytes").alias("bytes"))


def q_write_files(spark, sf_dir):
    return tensors.write_files(flat(spark, sf_dir), _folder(spark, "files"), VPW, "npy")


def q_file_manifest(spark, sf_dir):
    return tensors.manifest(spark, _filed(spark, sf_dir, "safetensors")).select("name", "dtype", "offset", "numel", "itemsize")


def q_write_flat(spark, sf_dir):
    """The whole stream as one flat array file, read again."""
    path = f"{_folder(spark, 'flat')}/all.npy"
    tensors.write_npy(flat(spark, sf_dir), path)
    return tensors.read_stream(spark, path).select("pos", "x")


def q_container_roundtrip(spark, sf_dir):
    """Chunks of a file written as one container and read back: decoded values."""
    path = f"{_folder(spark, 'container')}/run.wp"
    container.write_container(plans.compress(_positions(zeros(spark, sf_dir)), _run()), path, {"mode": "cluster"})
    return plans.decompress(container.read_container(spark, path))


def q_container_footer(spark, sf_dir):
    """The container's own index of its windows."""
    path = f"{_folder(spark, 'footer')}/run.wp"
    container.write_container(plans.compress(_positions(zeros(spark, sf_dir)), _run()), path, {"mode": "cluster"})
    footer = container.read_footer(path)
    rows = [(e["index"], e["n_values"], e["n_outliers"], e["tuple_size"], footer["window_size"], footer["error_bound"]) for e in footer["chunks"]]
    return spark.createDataFrame(rows, "w long, n_values long, n_outliers long, tuple_size int, window_size long, error_bound double")


def q_file_run(spark, sf_dir):
    """A folder of files compressed by windows, stored, read by window and verified against the files."""
    path, cfg = _filed(spark, sf_dir, "npy"), _run()
    target = _folder(spark, "run")
    plans.write_run(plans.compress_file(spark, path, cfg), target)
    chunks = plans.read_run(spark, target)
    checked = plans.verify_chunks(None, chunks, source=tensors.read_windows(spark, path, VPW))
    return checked.withColumn("max_error", F.round("max_error", 9))


def q_codebook_tables(spark, sf_dir):
    """The codebooks of a run, stored apart by window."""
    target = _folder(spark, "books")
    plans.write_codebooks(plans.compress(flat(spark, sf_dir), _run()), target)
    return spark.read.parquet(f"{target}/codebooks").select(F.col("w").cast("long").alias("w"), "k", "tuple_size", F.length("centroids").alias("centroid_bytes"))


def q_command_line(spark, sf_dir):
    """compress, verify and decompress by the command line: exit codes, and a bound that doesn't hold."""
    from boundwell import cli

    path, target = _filed(spark, sf_dir, "npy"), _folder(spark, "cli")
    with contextlib.redirect_stdout(io.StringIO()):
        codes = [
            ("compress", cli.main(["compress", path, f"{target}/run.chunks", "-w", str(VPW * VALUE_BYTES), "--json"], spark)),
            ("verify", cli.main(["verify", path, f"{target}/run.chunks"], spark)),
            ("verify closer", cli.main(["verify", path, f"{target}/run.chunks", "-e", "1e-9"], spark)),
            ("decompress", cli.main(["decompress", f"{target}/run.chunks", f"{target}/back.npy"], spark)),
            ("verify decoded", cli.main(["verify", f"{target}/back.npy", f"{target}/run.chunks", "-e", "1e-9"], spark)),
        ]
    return spark.createDataFrame(codes, "command string, code int")


def q_experiment_run(spark, sf_dir):
    """Experiment rows of three modes, stored as JSON, read back and joined with their lossless sizes."""
    values, path = flat(spark, sf_dir), _folder(spark, "results")
    runs = {"cluster": _run(), "residual": _run("residual", "relative", k_start=2, max_k=2, kmeans_iters=2)}
    report.write_results(report.experiments(values, runs), path)
    found = report.with_lossless(report.load_results(spark, path), packing.lossless(values).selectExpr("'cluster' AS name", "*"))
    return found.select("name", "mode", "windows", "n_values", "raw_bytes", "violations", "unmatched", "passed", (F.col("lossless_ratio") > 0.9).alias("has_lossless"))


def q_experiment_plan(spark, sf_dir):
    """The runs that the groups plan, of the models whose files exist."""
    path = _filed(spark, sf_dir, "npy")
    plan = report.planned({"none": f"{path}/missing.npy", "weights": path})
    return spark.createDataFrame([(n, c.mode, c.error_bound) for n, _, c, _ in plan], "name string, mode string, error_bound double")


def q_seeded_start(spark, sf_dir):
    """Starts of a k-means: as many as asked for, each a tuple of the stream."""
    rows = pairs(spark, sf_dir)
    starts = spark.createDataFrame([tuple(c) for c in kmeans.initial(rows, 64, 7, ("w", "t"))], "a double, b double")
    there = rows.select(F.col("v0").cast("double").alias("a"), F.col("v1").cast("double").alias("b")).distinct()
    return starts.join(there, ["a", "b"], "left").agg(F.count("*").alias("starts"), F.count_if(F.col("a").isNull()).alias("strangers"))


def q_tuple_sample(spark, sf_dir):
    """The sample of a fit: all tuples of a window where it has no more than are asked for, in a stream of any length."""
    return kmeans.sample(pairs(spark, sf_dir), 64, Config(), ("w", "t")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("v0").cast("double")), 6).alias("v0"))


def q_lossless_source(spark, sf_dir):
    """Lossless sizes of a file's own bytes."""
    path = f"{_folder(spark, 'lossless')}/all.npy"
    tensors.write_npy(flat(spark, sf_dir), path)
    sizes_ = packing.lossless_file(spark, path)
    return sizes_.select("raw_bytes", ((F.col("plain_bytes") > 0) & (F.col("planes_bytes") < F.col("raw_bytes"))).alias("smaller"))


def q_lossless(spark, sf_dir):
    return packing.lossless(flat(spark, sf_dir))


def q_kmeans_mllib(spark, sf_dir):
    found = kmeans.mllib_centroids(pairs(spark, sf_dir), 16, Config(kmeans_iters=5))
    return kmeans.assign(pairs(spark, sf_dir), found).groupBy("label").agg(F.count("*").alias("n"))


def q_search_k(spark, sf_dir):
    """The trials of the search for k over pairs, and the one chosen."""
    cfg = Config(mode="residual", error_mode="absolute", k_start=4, max_k=16, kmeans_iters=2)
    _, best, trials = kmeans.best_clusters(pairs(spark, sf_dir), cfg)
    return spark.createDataFrame([(t.k, int(t.est_bytes), t is best) for t in trials], "k int, est_bytes long, chosen boolean")


def q_report_table(spark, sf_dir):
    """The k histogram of the stream as the lines of a Markdown report, set between its markers."""
    rows = [r.asDict() for r in q_k_histogram(spark, sf_dir).collect()]
    text = report.splice("# Runs\n\n<!-- k -->\nold\n<!-- /k -->\n", "k", report.markdown(rows, ["k", "windows", "none"]))
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line int, text string")


def q_size_texts(spark, sf_dir):
    """Sizes as the command line reads and writes them."""
    texts = ["7", "4096", "1.5 KiB", "128MB", "2 G", "1TB"]
    return spark.createDataFrame([(t, parse_size(t), human(parse_size(t))) for t in texts], "text string, bytes long, shown string")


def q_window_plan(spark, sf_dir):
    """How many windows of a size fit a budget, at most eight."""
    found = [(b, w, report.plan_concurrency(b, w, 8)) for b in (0, 100, 1000) for w in (0, 30, 2000)]
    return spark.createDataFrame(found, "budget long, window long, at_a_time int")


def q_search_windows(spark, sf_dir):
    """The trials of each window's own search for k, with the settings' defaults."""
    chunks = plans.compress(flat(spark, sf_dir), _run("residual", "absolute"))
    each = chunks.select("w", F.col("k").alias("best"), F.inline("trials"))
    return each.select("w", "k", F.col("est_bytes").cast("long").alias("est_bytes"), (F.col("k") == F.col("best")).alias("chosen"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}


# ---------------------------------------------------------------------------------------------------------------- SQL

_STREAM = f"flat AS (SELECT vec_id * {DIM} + j AS pos, x::FLOAT AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings))"
_WINDOWS = f"r AS (SELECT pos, x, pos // {VPW} AS w, pos % {VPW} AS i FROM s)"
_SOURCES = {
    "plain": f"{_STREAM}, s AS (SELECT * FROM flat), {_WINDOWS}",
    "zeros": f"{_STREAM}, s AS (SELECT pos, CASE WHEN pos % 7 = 0 THEN 0::FLOAT ELSE x END AS x FROM flat), {_WINDOWS}",
    "events": f"s AS (SELECT event_id AS pos, value::FLOAT AS x FROM events WHERE value IS NOT NULL), {_WINDOWS}",
}


def _params(bound: float, name: str = "p") -> str:
    ladder = " ".join(f"WHEN NOT (span / {float(64 << j)!r} > {S.cell_width(bound)!r}) THEN {64 << j}" for j in range(18))
    return (
        f"{name}0 AS (SELECT w, count(*) AS n, coalesce(min(u), 0.0::DOUBLE) AS umin, coalesce(max(u), 0.0::DOUBLE) AS umax FROM (SELECT w, CASE WHEN x <> 0 AND abs(x) < 'inf'::FLOAT THEN ln(abs(x::DOUBLE)) END AS u FROM r) GROUP BY w), "
        f"{name}1 AS (SELECT *, greatest(umax - umin, 1e-30::DOUBLE) AS span FROM {name}0), "
        f"{name} AS (SELECT w, n, umin, umax, span, (CASE {ladder} ELSE {1 << 24} END)::BIGINT AS k FROM {name}1)"
    )


def _encoded(bound: float) -> str:
    return (
        f"{_params(bound)}, e0 AS (SELECT r.w, i, x, n, k, umin, span / k AS cellw, CASE WHEN x <> 0 AND abs(x) < 'inf'::FLOAT THEN ln(abs(x::DOUBLE)) ELSE 0.0::DOUBLE END AS u, CASE WHEN x < 0 THEN -1 ELSE 1 END AS sign FROM r JOIN p ON r.w = p.w), "
        "e1 AS (SELECT *, least(greatest(floor((u - umin) / cellw), 0), k - 1)::BIGINT AS cell FROM e0), e2 AS (SELECT *, (umin + (cell + 0.5::DOUBLE) * cellw)::FLOAT AS c FROM e1), e3 AS (SELECT *, (sign * exp(c::DOUBLE))::FLOAT AS xhat FROM e2), "
        "e4 AS (SELECT *, abs(xhat::DOUBLE - x::DOUBLE) / greatest(abs(x::DOUBLE), 1e-300::DOUBLE) AS rel0 FROM e3), "
        f"e5 AS (SELECT *, x = 0 OR NOT abs(x) < 'inf'::FLOAT OR rel0 > {bound!r}::DOUBLE AS esc FROM e4), e AS (SELECT *, CASE WHEN esc THEN 0.0::DOUBLE ELSE rel0 END AS rel FROM e5), "
        "b AS (SELECT w, cell, any_value(c) AS c, count(*) AS n, row_number() OVER (PARTITION BY w ORDER BY cell) - 1 AS label FROM e GROUP BY w, cell)"
    )


_STATS = "SELECT w, n::BIGINT AS n, k, occupied, n_escapes::BIGINT AS n_escapes, round(max_error, 9) AS max_error, round(mean_error, 9) AS mean_error FROM (SELECT w, count(*) AS n, any_value(k) AS k, count(DISTINCT cell) AS occupied, count(*) FILTER (esc) AS n_escapes, max(rel) AS max_error, sum(rel) / count(*) AS mean_error FROM e GROUP BY w)"


def _codes(relative: bool, bound: float) -> str:
    own = math.log1p(bound) if relative else bound
    value = "CASE WHEN x <> 0 AND abs(x) < 'inf'::FLOAT THEN ln(abs(x::DOUBLE)) ELSE 0.0::DOUBLE END" if relative else "x::DOUBLE"
    guard = f"least(greatest({own * S.GUARD_PART!r}::DOUBLE, largest * {S.GUARD_ULP!r}::DOUBLE), {S.GUARD_MOST * own!r}::DOUBLE)"
    step = "(CASE WHEN code0 > 0 THEN code0 - 1 ELSE code0 END)::FLOAT * step::FLOAT"
    decoded = f"((CASE WHEN x < 0 THEN -1 ELSE 1 END) * exp(({step})::DOUBLE))::FLOAT" if relative else f"({step})::FLOAT"
    error = "abs(xhat::DOUBLE - x::DOUBLE) / greatest(abs(x::DOUBLE), 1e-300::DOUBLE)" if relative else "abs(xhat::DOUBLE - x::DOUBLE)"
    strange = " OR x = 0" if relative else ""
    return (
        f"v AS (SELECT w, i, x, {value} AS v FROM r), st AS (SELECT w, 2 * ({own!r}::DOUBLE - {guard}) AS step FROM (SELECT w, max(abs(v)) AS largest FROM v GROUP BY w)), "
        "c0 AS (SELECT v.*, step, round_even((v - 0.0::FLOAT::DOUBLE) / step, 0) AS q FROM v JOIN st ON v.w = st.w), "
        f"c1 AS (SELECT *, CASE WHEN q < {-CODE_MAX} OR q > {CODE_MAX - 1} THEN 0 WHEN q >= 0 THEN q::BIGINT + 1 ELSE q::BIGINT END AS code0 FROM c0), c2 AS (SELECT *, {decoded} AS xhat FROM c1), c3 AS (SELECT *, {error} AS err FROM c2), "
        f"c4 AS (SELECT *, code0 = 0 OR err > {bound!r}::DOUBLE{strange} AS bad FROM c3), c5 AS (SELECT *, CASE WHEN bad THEN 0 ELSE code0 END AS code FROM c4), z AS (SELECT *, CASE WHEN code >= 0 THEN 2 * code ELSE -2 * code - 1 END AS z FROM c5), "
        "h AS (SELECT w, plane, byte, count(*) AS n FROM (SELECT w, unnest([0, 1, 2, 3]) AS plane, unnest([z & 255, (z >> 8) & 255, (z >> 16) & 255, (z >> 24) & 255]) AS byte FROM z) GROUP BY ALL), "
        "pe AS (SELECT w, plane, sum(-(n / t) * log2(n / t)) AS bits FROM (SELECT *, (sum(n) OVER (PARTITION BY w, plane))::DOUBLE AS t FROM h) GROUP BY w, plane), "
        "ov AS (SELECT w, count(*) AS n, count(*) FILTER (z >= 256) AS o1, count(*) FILTER (z >= 65536) AS o2, count(*) FILTER (z >= 16777216) AS o3 FROM z GROUP BY w), "
        "wc AS (SELECT pe.w, plane + 1 AS width, sum(bits * n / 8) OVER (PARTITION BY pe.w ORDER BY plane) + 8 * [o1, o2, o3, 0][plane + 1] AS cost FROM pe JOIN ov ON pe.w = ov.w), "
        "wd AS (SELECT w, arg_min(width, (cost, width)) AS width, min(cost) AS cost FROM wc GROUP BY w), "
        "f AS (SELECT z.* EXCLUDE (code, z), width, bad OR (width < 4 AND z >= (1::BIGINT << (8 * width))) AS esc, code AS code1, z AS z1 FROM z JOIN wd ON z.w = wd.w), "
        "g AS (SELECT *, CASE WHEN esc THEN 0 ELSE code1 END AS code, CASE WHEN esc THEN 0 ELSE z1 END AS z, CASE WHEN esc THEN 0.0 ELSE err END AS err2 FROM f)"
    )


def _grid(centroids) -> str:
    rows = ", ".join(f"({k}, {float(a)!r}::DOUBLE, {float(b)!r}::DOUBLE)" for k, (a, b) in enumerate(centroids))
    return f"cents(label, a, b) AS (VALUES {rows})"


_PAIRS = "t AS (SELECT w, i // 2 AS t, max(x) FILTER (i % 2 = 0) AS v0, coalesce(max(x) FILTER (i % 2 = 1), max(x) FILTER (i % 2 = 0)) AS v1 FROM r GROUP BY w, i // 2)"
_DIST = "(v0::DOUBLE - a) * (v0::DOUBLE - a) + (v1::DOUBLE - b) * (v1::DOUBLE - b)"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _near(name: str, cents: str) -> str:
    """Nearest centroid of each pair, the first of equals."""
    return f"{name} AS (SELECT w, t, any_value(v0) AS v0, any_value(v1) AS v1, arg_min(label, (d, label)) AS label, arg_min(a, (d, label)) AS c0, arg_min(b, (d, label)) AS c1, min(d) AS dist FROM (SELECT w, t, v0, v1, label, a, b, {_DIST} AS d FROM t, {cents}) GROUP BY w, t)"


P, Z, V = _SOURCES["plain"], _SOURCES["zeros"], _SOURCES["events"]


def _lloyd(times: int) -> str:
    parts, cents = [], "cents"
    for n in range(times):
        parts += [_near(f"a{n}", cents), f"l{n} AS (SELECT label, avg(v0::DOUBLE) AS a, avg(v1::DOUBLE) AS b FROM a{n} GROUP BY label)"]
        cents = f"l{n}"
    return ", ".join([*parts, _near("a", cents)])


_GAPPY = f"g AS (SELECT pos + {3 * VPW} * (pos // 4096) AS pos, x FROM flat WHERE pos % 5 <> 3 AND pos % 11 <> 0)"
_DECODED = "SELECT w, i, CASE WHEN esc THEN x ELSE xhat END AS x FROM e"

SQL: dict[str, str] = {
    "flat_stream": _with(_STREAM) + "SELECT pos, x FROM flat",
    "count_windows": _with(P) + "SELECT w, count(*) AS n, min(i) AS first, max(i) AS last FROM r GROUP BY w",
    "tail_window": _with(P) + "SELECT arg_max(n, w) AS tail, count(*) AS windows FROM (SELECT w, count(*) AS n FROM r GROUP BY w)",
    "limit_prefix": _with(_STREAM) + "SELECT pos, x FROM flat WHERE pos < 1000",
    "concat_whole": _with(_STREAM) + "SELECT pos, x FROM flat UNION ALL SELECT event_id + (SELECT max(pos) + 1 FROM flat), value::FLOAT FROM events WHERE value IS NOT NULL",
    "widen": "SELECT o_orderkey AS pos, o_totalprice::FLOAT AS x FROM orders",
    "widen_int": "SELECT p_partkey AS pos, p_size::FLOAT AS x FROM part",
    "log_ends": _with(P, _params(EB)) + "SELECT w, n, umin::FLOAT AS umin, umax::FLOAT AS umax FROM p",
    "log_ends_events": _with(V, _params(EB)) + "SELECT w, n, umin::FLOAT AS umin, umax::FLOAT AS umax FROM p",
    "k_by_window": _with(P, _params(EB)) + "SELECT w, k FROM p",
    "k_histogram": _with(P, _params(EB)) + "SELECT k, count(*) AS windows FROM p GROUP BY k",
    "cluster_labels": _with(P, _encoded(EB)) + "SELECT e.w, i, e.cell, label::INT AS label FROM e JOIN b ON e.w = b.w AND e.cell = b.cell",
    "cluster_codebook": _with(P, _encoded(EB)) + "SELECT w, label::INT AS label, cell, c, n FROM b",
    "cluster_decode": _with(P, _encoded(EB)) + _DECODED,
    "cluster_stats": _with(P, _encoded(EB)) + _STATS,
    "cluster_stats_events": _with(V, _encoded(EB)) + _STATS,
    "cluster_zeros": _with(Z, _encoded(EB)) + _STATS,
    "escape_overlay": _with(Z, _encoded(EB)) + _DECODED,
    "escape_zeros": "SELECT x = 0 AS esc, count(*) AS n, min(x) AS low, max(x) AS high FROM (SELECT l_discount::FLOAT AS x FROM lineitem) GROUP BY 1",
    "bound_sweep": " UNION ALL ".join(f"SELECT {n} AS exponent, w, k, occupied, n_escapes FROM ({_with(P, _encoded(b)) + _STATS})" for n, b in zip((2, 3, 4, 5, 6), BOUNDS, strict=True)),
    "experiment_summary": " UNION ALL ".join(
        f"SELECT {n} AS exponent, count(*) AS windows, sum(n)::BIGINT AS n_values, max(k) AS k, max(occupied) AS occupied, sum(n_escapes)::BIGINT AS n_outliers, max(max_error) AS max_error, round(sum(mean0 * n) / sum(n), 9) AS mean_error "
        f"FROM ({_with(P, _encoded(b)) + _STATS.replace('round(mean_error, 9) AS mean_error', 'mean_error AS mean0')})"
        for n, b in zip((2, 3, 4, 5, 6), BOUNDS, strict=True)
    ),
    "cluster_verify": _with(P, _encoded(EB), f"d AS (SELECT w, CASE WHEN x = 0 OR esc THEN 0.0::DOUBLE ELSE rel0 END AS err FROM e)") + f"SELECT count(*)::BIGINT AS n_values, count(DISTINCT w) AS n_windows, round(max(err), 9) AS max_error, (count(*) FILTER (err > {EB!r}))::BIGINT AS violations, count(*) FILTER (err > {EB!r}) = 0 AS passed FROM d",
    "unmatched": _with(P) + "SELECT w, i, 1 AS in_source, NULL::INT AS in_decoded FROM r WHERE i % 1000 = 5",
    "sign_bytes": _with(P) + "SELECT w, i // 8 AS byte, sum(CASE WHEN x < 0 THEN 1 << (i % 8)::INT ELSE 0 END)::INT AS bits FROM r GROUP BY w, i // 8",
    "resid_abs_codes": _with(P, _codes(False, EB)) + "SELECT w, i, code::INT AS code, z, xhat, esc FROM g",
    "resid_rel_codes": _with(P, _codes(True, 1e-3)) + "SELECT w, i, code::INT AS code, z, xhat, esc FROM g",
    "resid_abs_stats": _with(P, _codes(False, EB)) + "SELECT w, count(*) AS n, any_value(width)::INT AS width, count(*) FILTER (esc) AS n_escapes, round(max(err2), 9) AS max_error FROM g GROUP BY w",
    "resid_rel_stats": _with(Z, _codes(True, 1e-3)) + "SELECT w, count(*) AS n, any_value(width)::INT AS width, count(*) FILTER (esc) AS n_escapes, round(max(err2), 9) AS max_error FROM g GROUP BY w",
    "resid_verify": _with(Z, _codes(False, EB)) + f"SELECT count(*)::BIGINT AS n_values, count(DISTINCT w) AS n_windows, round(max(err2), 9) AS max_error, (count(*) FILTER (err2 > {EB!r}))::BIGINT AS violations, count(*) FILTER (err2 > {EB!r}) = 0 AS passed FROM g",
    "zigzag": _with(P, _codes(False, EB)) + "SELECT w, i, code::INT AS code, z, code::INT AS back FROM z",
    "plane_split": _with(P, _codes(False, EB)) + "SELECT w, i, (z & 255)::INT AS p0, ((z >> 8) & 255)::INT AS p1, ((z >> 16) & 255)::INT AS p2, ((z >> 24) & 255)::INT AS p3, z AS joined FROM z",
    "planes_needed": _with(P, _codes(False, EB)) + "SELECT w, planes, CASE planes WHEN 1 THEN 256 WHEN 2 THEN 65536 WHEN 3 THEN 16777216 END::BIGINT AS limit FROM (SELECT w, CASE WHEN max(z) < 256 THEN 1 WHEN max(z) < 65536 THEN 2 WHEN max(z) < 16777216 THEN 3 ELSE 4 END AS planes FROM z GROUP BY w)",
    "plane_histogram": _with(P, _codes(False, EB)) + "SELECT w, plane, byte::INT AS byte, n FROM h",
    "plane_entropy": _with(P, _codes(False, EB)) + "SELECT w, plane, round(bits, 6) + 0.0 AS bits FROM pe",
    "choose_width": _with(P, _codes(False, EB)) + "SELECT w, width::INT AS width, round(cost, 3) AS cost FROM wd",
    "label_entropy": _with(P, _encoded(EB)) + "SELECT w, round(sum(-(n / t) * log2(n / t)), 6) AS bits, count(*) AS bins, sum(n)::BIGINT AS n FROM (SELECT *, (sum(n) OVER (PARTITION BY w))::DOUBLE AS t FROM b) GROUP BY w",
    "label_width": _with(P, _encoded(EB)) + "SELECT w, CASE WHEN count(*) <= 256 THEN 1 WHEN count(*) <= 65536 THEN 2 ELSE 4 END AS label_bytes FROM b GROUP BY w",
    "est_bytes": _with(P, _PAIRS, _grid(GRID), _near("a", "cents"))
    + f", lv AS (SELECT v0 AS x, c0 AS c FROM a UNION ALL SELECT v1, c1 FROM a), q AS (SELECT least(greatest(round_even((x::DOUBLE - c) / {S.step_value(EB)!r}::DOUBLE, 0), -32768), 32768)::INT AS code, abs(c - x::DOUBLE) AS err FROM lv), "
    + "lb AS (SELECT sum(-(n / t) * log2(n / t)) AS bits, sum(n) AS n FROM (SELECT count(*) AS n, (sum(count(*)) OVER ())::DOUBLE AS t FROM a GROUP BY label)), cb AS (SELECT sum(-(n / t) * log2(n / t)) AS bits, sum(n) AS n FROM (SELECT count(*) AS n, (sum(count(*)) OVER ())::DOUBLE AS t FROM q GROUP BY code)) "
    + "SELECT (floor((lb.n * lb.bits + cb.n * cb.bits) / 8) + 128)::BIGINT AS est_bytes, round(lb.bits, 6) AS label_bits, round(cb.bits, 6) AS code_bits, round((SELECT max(err) FROM q), 9) AS max_error, round((SELECT avg(err) FROM q), 9) AS mean_error FROM lb, cb",
    "escape_delta": _with(Z, _encoded(EB)) + "SELECT w, i, i - lag(i, 1, 0) OVER (PARTITION BY w ORDER BY i) AS delta FROM e WHERE esc",
    "escape_cumsum": _with(Z, _encoded(EB)) + "SELECT w, i, i AS place FROM e WHERE esc",
    "tuples2": _with(P, _PAIRS) + "SELECT w, t, v0, v1 FROM t",
    "tuples3": _with(P) + "SELECT w, i // 3 AS t, arg_min(x, i) AS v0, coalesce(max(x) FILTER (i % 3 = 1), arg_max(x, i)) AS v1, coalesce(max(x) FILTER (i % 3 = 2), arg_max(x, i)) AS v2 FROM r GROUP BY w, i // 3",
    "nearest_centroid": _with(P, _PAIRS, _grid(GRID), _near("a", "cents")) + "SELECT w, t, label, round(dist, 9) AS dist FROM a",
    "lloyd_step": _with(P, _PAIRS, _grid(GRID), _near("a", "cents")) + "SELECT label, count(*) AS n, round(avg(v0::DOUBLE), 6) AS m0, round(avg(v1::DOUBLE), 6) AS m1 FROM a GROUP BY label",
    "lloyd_steps": _with(P, _PAIRS, _grid(GRID), _lloyd(5)) + "SELECT label, count(*) AS n, round(any_value(c0), 6) AS c0, round(any_value(c1), 6) AS c1 FROM a GROUP BY label",
    "empty_clusters": _with(P, _PAIRS, _grid(GRID_AND_FAR), _near("a", "cents")) + "SELECT label FROM cents WHERE label NOT IN (SELECT label FROM a)",
    "worst_fit": _with(P, _PAIRS, _grid(GRID), _near("a", "cents")) + "SELECT w, t, v0, v1, label FROM a ORDER BY dist DESC, w, t LIMIT 10",
    "strided_sample": _with(P) + "SELECT w, i, x FROM r WHERE i % 8 = 0",
    "vq_error": _with(P, _PAIRS, _grid(GRID), _near("a", "cents")) + "SELECT w, round(max(greatest(abs(c0 - v0::DOUBLE), abs(c1 - v1::DOUBLE))), 9) AS max_error FROM a GROUP BY w",
    "restore_whole": _with(_STREAM) + f"SELECT 'v' || (pos // {DIM})::VARCHAR AS name, (pos // {DIM}) * {DIM} AS offset, (pos % {DIM})::INT AS place, x FROM flat WHERE pos // {DIM} < (SELECT max(pos) // {DIM} FROM flat)",
    "run_stats": _with(Z, _encoded(EB), f"ws AS (SELECT w, n_values, occupied, n_outliers, max_error, occupied * 4 AS cb, n_values * (CASE WHEN occupied <= 256 THEN 1 WHEN occupied <= 65536 THEN 2 ELSE 4 END) AS lb, (n_values + 7) // 8 + n_outliers * 8 AS ob FROM (SELECT w, count(*) AS n_values, count(DISTINCT cell) AS occupied, count(*) FILTER (esc) AS n_outliers, max(rel) AS max_error FROM e GROUP BY w))")
    + "SELECT count(*) AS windows, sum(n_values)::BIGINT AS n_values, (4 * sum(n_values))::BIGINT AS raw_bytes, sum(cb + lb + ob)::BIGINT AS stored_bytes, sum(cb)::BIGINT AS codebook_bytes, sum(lb)::BIGINT AS label_bytes, 0::BIGINT AS code_bytes, sum(ob)::BIGINT AS outlier_bytes, sum(n_outliers)::BIGINT AS n_outliers, round(max(max_error), 9) AS max_error, min(occupied) AS min_occupied, max(occupied) AS max_occupied, "
    + "round((4 * sum(n_values))::DOUBLE / sum(cb + lb + ob), 9) AS ratio, round(8 * sum(cb + lb + ob)::DOUBLE / sum(n_values), 9) AS bits_per_value FROM ws",
    "pack_roundtrip": _with(Z, _encoded(EB)) + _DECODED,
    "log_error": _with(P, _encoded(EB)) + "SELECT w, round(m, 9) AS log_error, round(exp(m) - 1, 9) AS as_relative FROM (SELECT w, coalesce(max(abs(c::DOUBLE - u)) FILTER (NOT esc), 0.0) AS m FROM e GROUP BY w)",
    "compress_roundtrip": _with(_STREAM, _GAPPY) + f"SELECT pos, x, true AS held FROM g",
    "verify_run": _with(_STREAM, _GAPPY, "c AS (SELECT count(*) AS n, count(*) FILTER (pos // 8192 = 3) AS lost, count(*) FILTER (pos % 7 = 1) AS holes, count(*) FILTER (x <> 0) AS other FROM g)")
    + "SELECT 'whole' AS run, n::BIGINT AS n_values, 0::BIGINT AS violations, 0::BIGINT AS unmatched, true AS passed FROM c UNION ALL SELECT 'window lost', n - lost, 0, lost, lost = 0 FROM c UNION ALL SELECT 'values lost', n - holes, 0, holes, false FROM c UNION ALL SELECT 'other values', n, other, 0, false FROM c UNION ALL SELECT 'source lacks', n - holes, 0, holes, false FROM c",
    "vq_chunks": _with(P) + "SELECT w, 'vq' AS mode, 4 AS k, 2 AS tuple_size, count(*) AS n_values, 32 AS centroid_bytes, 0 AS planes, 0 AS sign_bytes, 0::BIGINT AS n_outliers, 0.0::DOUBLE AS step, 8192::BIGINT AS window_values FROM r GROUP BY w",
    "residual_tuples": _with(P) + f"SELECT w, 4 AS k, 3 AS tuple_size, count(*) AS n_values, 48 AS centroid_bytes, true AS held, {EB!r}::DOUBLE AS error_bound, 8192::BIGINT AS window_values, 0::BIGINT AS bad, 0::BIGINT AS unmatched FROM r GROUP BY w",
    "window_report": _with(P, _encoded(EB)) + "SELECT w, 'cluster' AS mode, count(DISTINCT cell)::INT AS occupied, count(*) AS n_values, 4 * count(*) AS raw_bytes, 4 * count(DISTINCT cell) AS codebook_bytes, count(*) FILTER (esc) AS n_outliers, round(max(rel), 9) AS max_error, round(sum(rel) / count(*), 9) AS mean_error, 0 AS trials, 100.0::DOUBLE AS share FROM e GROUP BY w",
    "read_npy": _with(_STREAM) + "SELECT pos, x FROM flat",
    "read_safetensors": _with(_STREAM) + "SELECT 'part' || lpad((pos // 8192)::VARCHAR, 8, '0') AS name, pos, x FROM flat",
    "read_raw": _with(_STREAM) + "SELECT pos, x FROM flat",
    "read_windows": _with(_STREAM) + "SELECT pos // 5000 AS w, 0::BIGINT AS first, 4 * count(*) AS bytes FROM flat GROUP BY pos // 5000",
    "write_files": _with(_STREAM) + "SELECT 'part-' || lpad((pos // 8192)::VARCHAR, 8, '0') || '.npy' AS file, count(*) AS n_values FROM flat GROUP BY pos // 8192",
    "file_manifest": _with(_STREAM) + "SELECT 'part' || lpad((pos // 8192)::VARCHAR, 8, '0') AS name, 'F32' AS dtype, min(pos) AS offset, count(*) AS numel, 4 AS itemsize FROM flat GROUP BY pos // 8192",
    "write_flat": _with(_STREAM) + "SELECT pos, x FROM flat",
    "container_roundtrip": _with(Z, _encoded(EB)) + f"SELECT w * {VPW} + i AS pos, x FROM ({_DECODED})",
    "container_footer": _with(Z, _encoded(EB)) + f"SELECT w, count(*) AS n_values, count(*) FILTER (esc) AS n_outliers, 1 AS tuple_size, {4 * VPW}::BIGINT AS window_size, {EB!r}::DOUBLE AS error_bound FROM e GROUP BY w",
    "file_run": _with(P, _encoded(EB)) + "SELECT count(*)::BIGINT AS n_values, count(DISTINCT w) AS n_windows, round(max(rel), 9) AS max_error, 0::BIGINT AS violations, 0::BIGINT AS unmatched, true AS passed FROM e",
    "codebook_tables": _with(P, _encoded(EB)) + "SELECT w, count(DISTINCT cell)::INT AS k, 1 AS tuple_size, (4 * count(DISTINCT cell))::INT AS centroid_bytes FROM e GROUP BY w",
    "command_line": "SELECT * FROM (VALUES ('compress', 0), ('verify', 0), ('verify closer', 1), ('decompress', 0), ('verify decoded', 0)) AS t(command, code)",
    "experiment_run": _with(P) + "SELECT name, name AS mode, count(DISTINCT w) AS windows, count(*) AS n_values, 4 * count(*) AS raw_bytes, 0::BIGINT AS violations, 0::BIGINT AS unmatched, true AS passed, CASE WHEN name = 'cluster' THEN true END AS has_lossless FROM r, (VALUES ('cluster'), ('residual')) AS t(name) GROUP BY name",
    "experiment_plan": "SELECT * FROM (VALUES ('model-weights', 'cluster', 1e-4::DOUBLE), ('bound-1e-02', 'cluster', 1e-2::DOUBLE), ('bound-1e-03', 'cluster', 1e-3::DOUBLE), ('bound-1e-04', 'cluster', 1e-4::DOUBLE), ('bound-1e-05', 'cluster', 1e-5::DOUBLE), ('bound-1e-06', 'cluster', 1e-6::DOUBLE), ('method-cluster', 'cluster', 1e-4::DOUBLE), ('method-residual', 'residual', 1e-4::DOUBLE), ('method-vq', 'vq', 1e-4::DOUBLE)) AS t(name, mode, error_bound)",
    "report_table": _with(P, _params(EB), "h AS (SELECT k, count(*) AS n FROM p GROUP BY k)", "t AS (SELECT 4 + row_number() OVER (ORDER BY k) AS line, '| 2^' || log2(k)::INT || ' | ' || n || ' | - |' AS text FROM h)")
    + "SELECT line::INT AS line, text FROM t UNION ALL SELECT * FROM (VALUES (0, '# Runs'), (1, ''), (2, '<!-- k -->'), (3, '| k | windows | none |'), (4, '|-|-|-|')) UNION ALL SELECT (5 + count(*))::INT, '<!-- /k -->' FROM h",
    "size_texts": "SELECT * FROM (VALUES ('7', 7::BIGINT, '7 B'), ('4096', 4096, '4.00 KiB'), ('1.5 KiB', 1536, '1.50 KiB'), ('128MB', 134217728, '128.00 MiB'), ('2 G', 2147483648, '2.00 GiB'), ('1TB', 1099511627776, '1.00 TiB')) AS t(text, bytes, shown)",
    "window_plan": 'SELECT budget, "window", greatest(1, least(8, budget // greatest(1, "window")))::INT AS at_a_time FROM (VALUES (0::BIGINT), (100), (1000)) AS b(budget), (VALUES (0::BIGINT), (30), (2000)) AS w("window")',
    "seeded_start": "SELECT 64::BIGINT AS starts, 0::BIGINT AS strangers",
    "tuple_sample": _with(P, _PAIRS) + "SELECT count(*) AS n, round(sum(v0::DOUBLE), 6) AS v0 FROM t",
    "lossless_source": _with(_STREAM) + "SELECT 4 * count(*) AS raw_bytes, true AS smaller FROM flat",
    "pack_residual_roundtrip": _with(Z) + "SELECT count(*)::BIGINT AS n_values, count(DISTINCT w) AS n_windows, 0::BIGINT AS violations, true AS passed FROM r",
}
