"""Best-two-fit packing of tokenised documents into sequences of fixed size.

Only lengths matter for a packing, and a piece has one of at most `capacity` lengths.  So the packing is planned on the
histogram of lengths, whose size doesn't grow with the corpus: a bin is filled greedily with the longest pieces that fit;
then its smallest piece is given back if two unpacked pieces fill the gap that this leaves more tightly; and the finished bin
is repeated as long as its lengths last.  The plan says, for each length, which of its pieces (by rank) go to which bins and places.

Ranks come without a sort or a gathering of a length's pieces: each task counts its own, and the tasks' counts are summed up
before it.

Defined results: null text counts as empty, which is one piece with the end id alone; documents longer than capacity are cut from
their end, so that only the first piece is shorter; repeated rows are pieces of their own; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boundwell.llm.bpe import _batches, codec
from boundwell.llm.runtime import cut, small_batches

CAPACITY = 2048
END_ID = 0


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = n % capacity or min(n, capacity)
    cuts = [0, *range(first, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, rank: rank counts the pieces of that length in task part. With ids, if asked for."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, part = codec(path), [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in batches:
            for first, texts in _batches(batch, "text"):
                ids_col = batch.column("doc_id").slice(first, len(texts))
                rows, which, kept = [], [], []
                for i, ids in enumerate(coder.encode_batch(texts)):
                    ids = np.append(ids, end_id).astype("<u4")
                    for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                        own = ids[start : start + length]
                        rows.append((k, start, length, zlib.crc32(own), part, seen[length]))
                        seen[length] += 1
                        which.append(i)
                        if with_ids:
                            kept.append(own.astype(np.int32))
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                columns = [ids_col.take(pa.array(which, pa.int32())), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(types))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how often), for counts of pieces by length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while left.any():
        bin_, gap = [], capacity
        have = left.copy()
        while len(fits := np.flatnonzero(have[1 : gap + 1])):
            length = int(fits[-1]) + 1
            # As many of this length as fit, then the next.
            n = min(int(have[length]), gap // length)
            bin_ += [length] * n
            have[length] -= n
            gap -= n * length
        if gap and len(bin_) > 1:
            small = bin_[-1]
            two = _best_two(have, gap + small)
            if two and sum(two) > small:
                have[small] += 1
                bin_ = [*bin_[:-1], *two]
        lengths, need = np.unique(bin_, return_counts=True)
        times = int((left[lengths] // need).min())
        left[lengths] -= times * need
        out.append((bin_, times))
    return out


def _best_two(have: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the greatest sum that is at most room."""
    lengths = np.flatnonzero(have[: room + 1])
    if not len(lengths):
        return None
    at = np.searchsorted(lengths, room - lengths, side="right") - 1
    # A length can't be its own partner unless there are two of it.
    alone = (at >= 0) & (lengths[at] == lengths) & (have[lengths] < 2)
    at = np.where(alone, at - 1, at)
    ok = at >= 0
    if not ok.any():
        return None
    sums = np.where(ok, lengths + lengths[np.maximum(at, 0)], -1)
    i = int(sums.argmax())
    return int(max(lengths[i], lengths[at[i]])), int(min(lengths[i], lengths[at[i]]))


def slots(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan as arrays, sorted by (length, first rank): need a bin, first bin, and each need's places in the bin."""
    next_rank: dict[int, int] = {}
    rows, places = [], []
    first_bin = 0
    for lengths, times in bins:
        at = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        for length in dict.fromkeys(lengths):
            own = [int(o) for o, x in zip(at, lengths, strict=True) if x == length]
            rank = next_rank.get(length, 0)
            rows.append((length, rank, len(own), first_bin, len(places)))
            places += own
            next_rank[length] = rank + times * len(own)
        first_bin += times
    rows.sort()
    names = ("length", "rank", "need", "bin", "place")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)} | {"places": np.array(places, np.int64)}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    small_batches(docs.sparkSession)
    rows = cut(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids))
    spark = docs.sparkSession
    by_part = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    # At most `capacity` rows, whatever the corpus.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    ranked = rows.join(bases.hint("shuffle_merge"), (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).withColumn("rank", F.col("rank") + F.col("_base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        wide = 1 << 40
        keys = p["length"] * wide + p["rank"] if len(p["length"]) else np.zeros(0, np.int64)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            j = rank - p["rank"][at]
            sequence = p["bin"][at] + j // p["need"][at]
            offset = p["places"][p["place"][at] + j % p["need"][at]]
            own = {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[n] if n in own else batch.column(n) for n in names], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.select(*names[:5], "rank", *names[7:]).mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def sequences(docs: DataFrame, path: str, **options) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the pieces' (doc_id, piece, offset). A sequence has at most `capacity` ids."""
    rows = pack(docs, path, with_ids=True, **options)
    part = F.struct("offset", "doc_id", "piece", "ids")
    whole = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return whole.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"))).alias("parts"))
