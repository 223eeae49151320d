"""Embedding near-duplicates by spherical-cap filters from a random product code.

A filter direction is a tuple of one random unit vector for each of BLOCKS parts of the (randomly rotated) space, CODES to choose from in
each part, so that CODES ** BLOCKS directions need no storage and the scores of a vector add up from its parts.  A vector's
cap holds all directions whose score is within REACH of its best one's; they are list-decoded from the parts' sorted sums,
never by trying all directions.  A vector is stored under its best direction and probes all directions of its cap: two
vectors meet if the best of one is in the cap of the other, and pairs that meet twice are counted where the smaller id is
stored.  Cosines of pairs that meet are computed in double precision from the whole vectors.

Equal vectors of a label are one node with a weight, so copies are not expanded.  Buckets are cut into blocks of stored and
blocks of probing vectors, a task's memory holds one block; tasks emit each vector's number of links and a spanning forest, never pairs.

Directions of few coordinates coincide, so a part has eight or more; below 32 dimensions there are two parts with as many
directions each as two of the four have otherwise, and below 8 there is one. Probes are moved only if a bitmap of bounded size, made
of the directions that have a stored vector, lets them pass; vectors follow when their bucket is known to have a pair.

Defined results: null labels, null vectors, vectors with null or non-finite components and zero vectors have no links; only
vectors of equal label and length are compared (labels that aren't whole numbers are compared as text); equal vectors of a label are
one node, with or without an id; rows that share an id are rows of their own; component_id is null where no row of the component has an
id, and these are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundwell.llm.components import Forest, components
from boundwell.llm.runtime import apart, cut, sieve, sifted

BLOCKS, CODES = 4, 32
#: Depth of a cap below the best score, for unit vectors of 64 components. Of pairs of cosine 0.98 none of 4000 was missed at 0.12.
REACH = 0.14
STORED_BLOCK, PROBE_BLOCK = 2048, 16384
COSINE = 0.98


def shape(dim: int) -> tuple[int, int]:
    """Parts, and directions to choose from in each. A part needs several coordinates, or its directions coincide."""
    if dim >= 8 * BLOCKS:
        return BLOCKS, CODES
    return (2, CODES ** (BLOCKS // 2)) if dim >= 8 else (1, CODES ** (BLOCKS // 2)) if dim > 1 else (1, 2)


@cache
def code(dim: int) -> tuple[np.ndarray, list[np.ndarray], list[slice]]:
    """A rotation, and for each part its directions and its coordinates."""
    rng = np.random.default_rng(dim)
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    n, codes = shape(dim)
    parts = [slice(int(x[0]), int(x[-1]) + 1) for x in np.array_split(np.arange(dim), n)]
    books = []
    for p in parts:
        c = rng.standard_normal((codes, p.stop - p.start)) if dim > 1 else np.array([[1.0], [-1.0]])
        books.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return rotation, books, parts


def depth(reach: float, dim: int) -> float:
    """Scores are closer together in more dimensions; with one or two parts directions are dense, and near vectors differ less in their scores."""
    if dim >= 8 * BLOCKS:
        return reach * (64 / dim) ** 0.4
    return reach * (1.0 if dim >= 12 else 0.8 if dim >= 8 else min(dim, 5) / 7)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def part_scores(units: np.ndarray) -> list[np.ndarray]:
    rotation, books, parts = code(units.shape[1])
    turned = units @ rotation
    return [turned[:, p] @ b.T for p, b in zip(parts, books, strict=True)]


def direction_scores(units: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Score of each vector (rows) for each direction (columns)."""
    total, (_, codes) = 0.0, shape(units.shape[1])
    for k, s in enumerate(part_scores(units)):
        total = total + s[:, directions // codes**k % codes]
    return total


def _halves(scores: list[np.ndarray]) -> list[tuple[np.ndarray, int]]:
    """Sums over the first and over the other parts, for all their combinations; and the weight of a half's number in a direction's."""
    half = (len(scores) + 1) // 2
    out = []
    for first, some in ((0, scores[:half]), (half, scores[half:])):
        total = np.zeros((len(scores[0]), 1))
        for s in some:
            total = (s[:, :, None] + total[:, None, :]).reshape(len(total), -1)
        out.append((total, scores[0].shape[1] ** first))
    return out


def best_scores(units: np.ndarray) -> np.ndarray:
    return sum(s.max(1) for s in part_scores(units))


def best_directions(units: np.ndarray) -> np.ndarray:
    (a, wa), (b, wb) = _halves(part_scores(units))
    return a.argmax(1) * wa + b.argmax(1) * wb


def decode_caps(units: np.ndarray, reach: float = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, direction) of all directions in the rows' caps; and each row's best direction."""
    (a, wa), (b, wb) = _halves(part_scores(units))
    top_a, top_b = a.max(1), b.max(1)
    best = a.argmax(1) * wa + b.argmax(1) * wb
    rows, found = [], []
    for i in range(len(units)):
        ia, ib = np.flatnonzero(a[i] >= top_a[i] - reach), np.flatnonzero(b[i] >= top_b[i] - reach)
        sums = a[i, ia][:, None] + b[i, ib][None, :]
        x, y = np.nonzero(sums >= top_a[i] + top_b[i] - reach - 1e-12)
        found.append(ia[x] * wa + ib[y] * wb)
        rows.append(np.full(len(x), i))
    return np.concatenate(rows), np.concatenate(found), best


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch, column: str = "vector") -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Rows of equal length: their places and their matrix."""
    size = np.array([len(x) for x in batch.column(column)], np.int64)
    for dim in np.unique(size):
        at = pa.array(np.flatnonzero(size == dim))
        yield at, _matrix(batch.column(column).take(at), int(dim))


def _decode(reach: float | None):
    """mapInArrow function: rows (label, node, vector) to rows (label, dim, direction, node, stored): the best direction of each vector, or with a reach all of its cap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                yield from decoded(whole.slice(start, 1000))

    def decoded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, matrix in _by_dim(batch):
            units, dim = unit(matrix), matrix.shape[1]
            label, node = batch.column("label").take(at), batch.column("node").take(at)
            if reach is None:
                rows, direction = np.arange(len(units)), best_directions(units)
            else:
                rows, direction, _ = decode_caps(units, depth(reach, dim))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([label.take(take), pa.array(np.full(len(rows), dim, np.int32)), pa.array(direction.astype(np.int64)), node.take(take), pa.array(np.full(len(rows), reach is None))], ["label", "dim", "direction", "node", "stored"])

    return run


def _link(cosine: float, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (label, dim, direction, bs, bp, stored first, node, weight, vector), a group's together: (u, v, links), links of u for v null, else an edge."""
        key, index, degree, forest = None, [], {}, Forest()

        def meet(stored: tuple, probing: tuple, direction: int) -> None:
            (a, wa, xa), (b, wb, xb) = stored, probing
            near = (xa @ xb.T >= cosine) & (a[:, None] != b[None, :])
            i, j = np.nonzero(near)
            if not len(i):
                return
            # Found here as (stored a, probing b). Where b < a and a probes b's best direction, the pair counts there.
            smaller = np.flatnonzero(b[j] < a[i])
            if len(smaller):
                ua, ub = np.unique(i[smaller]), np.unique(j[smaller])
                own = best_directions(xb[ub])
                inside = direction_scores(xa[ua], own) >= best_scores(xa[ua])[:, None] - depth(reach, xa.shape[1]) - 1e-12
                elsewhere = inside[np.searchsorted(ua, i[smaller]), np.searchsorted(ub, j[smaller])]
                keep = np.ones(len(i), bool)
                keep[smaller[elsewhere]] = False
                i, j = i[keep], j[keep]
            for nodes, at, weights in ((a, i, wb[j]), (b, j, wa[i])):
                for k, n in zip(*(x.tolist() for x in (np.unique(at), np.bincount(at, weights=weights)[np.unique(at)])), strict=True):
                    degree[int(nodes[k])] = degree.get(int(nodes[k]), 0) + int(n)
            for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True):
                if forest.find(x) != forest.find(y):
                    forest.union(x, y)

        def said() -> pa.RecordBatch:
            hi, lo = forest.edges()
            nodes = np.fromiter(degree, np.int64, len(degree))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((nodes, hi))), pa.array([None] * len(nodes) + lo.tolist(), pa.int64()), pa.array([degree[x] for x in nodes.tolist()] + [None] * len(hi), pa.int64())], ["u", "v", "links"])

        for batch in batches:
            names = ("label", "dim", "direction", "bs", "bp")
            keys = np.stack([batch.column(n).to_numpy() for n in names], 1).astype(np.int64) if batch.num_rows else np.zeros((0, 5), np.int64)
            stored = batch.column("stored").to_numpy(zero_copy_only=False)
            edge = np.ones(batch.num_rows, bool)
            edge[1:] = (keys[1:] != keys[:-1]).any(1) | (stored[1:] != stored[:-1])
            at = [*np.flatnonzero(edge).tolist(), batch.num_rows]
            for lo, hi in zip(at, at[1:], strict=False):
                own = tuple(keys[lo])
                part = batch.slice(lo, hi - lo)
                dim = int(own[1])
                rows = (part.column("node").to_numpy(), part.column("weight").to_numpy(), unit(_matrix(part.column("vector"), dim)))
                if own != key:
                    key, index = own, []
                if stored[lo]:
                    index.append(rows)
                else:
                    for held in index:
                        meet(held, rows, int(own[2]))
            if len(degree) + len(forest.parent) > 200_000:
                yield said()
                degree, forest = {}, Forest()
        yield said()

    return run


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", reach: float = REACH) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    v = F.col(vector_col)
    usable = F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    whole = vectors.schema[label_col].dataType.typeName() in ("byte", "short", "integer", "long")
    label = F.col(label_col).cast("long") if whole else F.xxhash64(F.col(label_col).cast("string"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.when(F.coalesce(usable, F.lit(False)), F.transform(v, lambda x: x.cast("double") + 0.0)).alias("vector"))
    good = rows.where("vector is not null")
    # One node for each distinct vector of a label, numbered apart from the ids.
    grouped = good.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    classes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))
    kinds = "label long, dim int, direction long, node long, stored boolean"
    marks = ("label", "dim", "direction")
    bucket = F.xxhash64(*marks).alias("bucket")
    searched = classes.select("label", "node", "vector")
    stored = cut(searched.mapInArrow(_decode(None), kinds).select("*", bucket))
    # Probes of directions under which nothing is stored end before they are moved.
    probes = sifted(searched.mapInArrow(_decode(reach), kinds).select("*", bucket), "bucket", sieve(stored, "bucket"))
    caps = cut(stored.unionByName(probes).drop("bucket"))
    same = lambda *names: [F.col(n) == F.col("_" + n) for n in names]
    sizes = caps.groupBy(*marks).agg(F.count_if("stored").alias("n"), F.count_if(~F.col("stored")).alias("m")).where("n > 0 and m > 1")
    blocks = sizes.select(*(apart(n).alias("_" + n) for n in marks), F.ceil(F.col("n") / STORED_BLOCK).cast("int").alias("ns"), F.ceil(F.col("m") / PROBE_BLOCK).cast("int").alias("np"))
    met = caps.join(blocks.hint("shuffle_merge"), same(*marks)).select(*marks, "node", "stored", "ns", "np")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("stored"), F.col("ns")).otherwise(F.col("np"))).cast("int")
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("stored"), F.col("np")).otherwise(F.col("ns")) - 1)))
    placed = dealt.select(*marks, F.when(F.col("stored"), F.col("own")).otherwise(F.col("other")).alias("bs"), F.when(F.col("stored"), F.col("other")).otherwise(F.col("own")).alias("bp"), "stored", "node")
    named = classes.select(F.col("node").alias("_node"), "weight", "vector")
    group = [*marks, "bs", "bp"]
    full = placed.join(named.hint("shuffle_merge"), same("node")).select(*group, "stored", "node", "weight", "vector")
    linked = cut(full.repartition(*group).sortWithinPartitions(*group, F.desc("stored")).mapInArrow(_link(cosine, reach), "u long, v long, links long"))
    degree = linked.where("links is not null").groupBy(F.col("u").alias("_node")).agg(F.sum("links").alias("links"))
    parts = cut(components(linked.where("v is not null").select("u", "v")))
    # The smallest id of each component.
    members = parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct())
    least = members.join(classes.select(F.col("node").alias("_node"), "id").hint("shuffle_merge"), same("node")).groupBy("component").agg(F.min("id").alias("least")).select(apart("component").alias("_component"), "least")
    led = members.join(least.hint("shuffle_merge"), same("component")).select(F.col("node").alias("_member"), "least")
    of_class = (
        classes.join(degree.hint("shuffle_merge"), same("node"), "left")
        .join(led.hint("shuffle_merge"), F.col("node") == F.col("_member"), "left")
        .select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "id").alias("component"))
    )
    out = rows.join(of_class.hint("shuffle_merge"), [F.col("label") == F.col("_label"), F.col("vector") == F.col("_vector")], "left")
    component = F.when(F.col("_label").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
