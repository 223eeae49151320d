"""MinHash near-duplicate detection with odd sketches.

A document is the set of its distinct shingles, as 64-bit hashes.  SAMPLES MinHash values are cut into BANDS; documents that agree in
a band meet in a bucket.  The samples are also folded into a parity bitmap (odd sketch): the population count of two sketches' XOR
tells how many samples differ, so a bucket's pairs are estimated without their sets, and without leaving the task.
A bucket hands on a spanning forest of its pairs with an estimate of MIN_ESTIMATE or more, never the pairs.  The forests' connected
components are neighbourhoods; every pair that could be a link lies inside one.  A neighbourhood's full sets are then compared
exactly, and the confirmed links' components are the result.

Documents with equal sets are one node from the start, so a group of copies of any size costs a row.  Buckets and
neighbourhoods beyond a size that one task holds are cut into blocks, and each two blocks are a task of their own: nothing is capped.
A link of similarity 0.8 shares no band with probability (1 - 0.8**4)**32 < 1e-7, and is estimated below MIN_ESTIMATE with less.

Nodes are numbers of distinct sets, apart from the ids, so that every 64-bit id is one and rows without an id are searched like
all others.  A row's text is found again by its mark, a digest of id and text.  Only texts of neighbourhoods are moved: a bitmap of
bounded size, made of their marks, is broadcast and lets few others pass.

Defined results: null and empty texts have the empty set, n_shingles 0 and are linked with nothing; rows that share an id are rows of
their own (where the id is its component's smallest, all of them are kept); component_id is null where no row of the component has an
id, and the first of these rows is kept; an empty table gives an empty result; other columns are not read. drop_near_copies leaves one row of each
component, the one of smallest id (nulls last) and, of rows that share it, the first; and all rows of empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwell.llm.bytehash import WORD_BYTE, PrefixHash, U, mix, packed, runs, slices
from boundwell.llm.components import Forest, components
from boundwell.llm.exact_dedup import WHITE
from boundwell.llm.runtime import apart, cut, fresh, sieve, sifted, small_batches

WORDS = 5
#: Least similarity, in percent.
PERCENT = 80
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
MIN_ESTIMATE = 0.55
#: Documents of a bucket, and shingles of a neighbourhood, that one block holds.
BUCKET_BLOCK = 2048
SET_BLOCK = 1 << 21

_FACTORS = np.random.default_rng(4).integers(1, 1 << 63, SAMPLES, dtype=U) * U(2) + U(1)


def column_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """shingle_sets() of a string column, a slice at a time."""
    for start, texts in slices(column):
        for first, hashed, bounds in shingle_sets(texts, words):
            yield start + first, hashed, bounds


def shingle_sets(texts: list[bytes], words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of texts: the index of the first, the documents' distinct shingles one after another (each sorted), and their bounds."""
    for first, buf, starts, _ in packed([t.lower() for t in texts]):
        s, e = runs(WORD_BYTE[buf])
        doc = np.searchsorted(starts, s, side="right") - 1
        word = PrefixHash(buf).mixed(s, e)
        sizes = np.bincount(doc, minlength=len(starts))
        n = len(word)
        hashed, place = np.zeros(n, U), np.arange(n)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        end_of = begin[1:][doc] if n else place
        # The shingle at each word, of as many words as the document has from there, up to `words`.
        for k in range(words):
            have = place + k < end_of
            hashed[have] = mix(hashed[have] * U(0x9E3779B97F4A7C15) + word[place[have] + k])
        whole = (place + words <= end_of) | ((sizes[doc] < words) & (place == begin[:-1][doc]) if n else np.zeros(0, bool))
        hashed, doc = hashed[whole], doc[whole]
        order = np.lexsort((hashed, doc))
        hashed, doc = hashed[order], doc[order]
        new = np.ones(len(hashed), bool)
        new[1:] = (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])
        hashed, doc = hashed[new], doc[new]
        yield first, hashed, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(starts)))))


def set_digests(hashed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set, as int64 (2 rows)."""
    out = np.zeros((2, len(bounds) - 1), U)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for i, salt in enumerate((0x2545F4914F6CDD1D, 0x8CB92BA72F3D8DD7)):
            out[i, some] = np.add.reduceat(mix(hashed ^ U(salt)), bounds[some])
    return out.view(np.int64)


def minhash(hashed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least value of each set under each of SAMPLES permutations (sets by samples); empty sets are left 0."""
    out = np.zeros((len(bounds) - 1, SAMPLES), U)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for k in range(SAMPLES):
            out[some, k] = np.minimum.reduceat(hashed * _FACTORS[k], bounds[some])
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(samples), BANDS), U)
    for r in range(ROWS):
        keys = mix(keys * U(0x9E3779B97F4A7C15) + samples[:, r::ROWS])
    return mix(keys + np.arange(BANDS, dtype=U)[None, :]).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps: each sample flips the bit that it hashes to (sets by 64-bit words)."""
    bit = (mix(samples + np.arange(SAMPLES, dtype=U)[None, :] * U(0xD6E8FEB86659FD93)) % U(SKETCH_BITS)).astype(np.int64)
    flat = bit + np.arange(len(samples))[:, None] * SKETCH_BITS
    odd = np.bincount(flat.ravel(), minlength=len(samples) * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, SKETCH_BITS), axis=1).view(U).reshape(len(samples), SKETCH_BITS // 64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity that sketches a and b (broadcast) tell."""
    flipped = np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)
    differing = np.log1p(-2 * np.minimum(flipped, SKETCH_BITS // 2 - 1) / SKETCH_BITS) / np.log1p(-2 / SKETCH_BITS)
    return 1 - differing / (2 * SAMPLES)


def text_mark(doc_id: Column, text: Column) -> Column:
    """A digest of id and text, by which a row's text is found again."""
    return F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"), 256))


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark, row, n_shingles, d1, d2 (digests of the set), bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "mark", "n_shingles", "d1", "d2", "bands", "sketch"]
        for batch in batches:
            for first, hashed, bounds in column_sets(batch.column("text"), words):
                n = len(bounds) - 1
                d = set_digests(hashed, bounds)
                samples = minhash(hashed, bounds)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(band_keys(samples).ravel()))
                sketch = pa.array([x.tobytes() for x in odd_sketch(samples)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), batch.column("mark").slice(first, n), pa.array(np.diff(bounds)), pa.array(d[0]), pa.array(d[1]), keys, sketch], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = rows.select("doc_id", text_mark(F.col("doc_id"), F.col("text")).alias("mark"), "text")
    found = marked.mapInArrow(run, "doc_id long, mark binary, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary")
    return found.withColumn("row", F.monotonically_increasing_id())


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups: rows whose first `keys` columns are equal stand together, and a table ends between groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            column = batch.column(k).to_numpy(zero_copy_only=False)
            edge[1:] |= column[1:] != column[:-1]
            if held:
                edge[0] |= column[0] != held[-1].column(k)[-1].as_py()
        at = np.flatnonzero(edge)
        if len(at) and held and (at[-1] or sum(h.num_rows for h in held)):
            yield pa.Table.from_batches([*held, batch.slice(0, int(at[-1]))])
            held = []
        elif len(at) and at[-1]:
            yield pa.Table.from_batches([batch.slice(0, int(at[-1]))])
        held.append(batch.slice(int(at[-1]) if len(at) else 0))
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    edge = np.zeros(table.num_rows + 1, bool)
    edge[[0, -1]] = True
    for k in range(keys):
        column = table.column(k).to_numpy()
        edge[1:-1] |= column[1:] != column[:-1]
    return np.flatnonzero(edge)


def blocked(rows: DataFrame, key: str, node: str, blocks: str) -> DataFrame:
    """Adds block columns i <= j: a group of `blocks` blocks becomes a group for each two of them, which has both blocks' rows."""
    own = F.pmod(F.xxhash64(node), F.col(blocks)).cast("int")
    other = F.explode(F.when(F.col(blocks) <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))).alias("other")
    wide = rows.withColumn("own", own).select("*", other)
    return wide.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other", blocks)


def _bucket_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, node, sketch), a group's together: edges of a spanning forest of its similar pairs."""
    found: set[tuple[int, int]] = set()
    for table in _groups(batches, 3):
        bounds = _bounds(table, 3)
        node = table.column("node").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), U).reshape(len(node), -1)
        size = np.diff(bounds)
        lead = np.repeat(bounds[:-1], size)
        near = estimate(sketch, sketch[lead]) >= MIN_ESTIMATE
        found.update(zip(node[near].tolist(), node[lead[near]].tolist(), strict=True))
        # Rows that aren't near the first of their group: against all of the group, which are not linked yet.
        for g in np.unique(np.searchsorted(bounds, np.flatnonzero(~near), side="right") - 1):
            a, b = bounds[g], bounds[g + 1]
            far = a + np.flatnonzero(~near[a:b])
            forest = Forest()
            for x in far.tolist():
                others = a + np.flatnonzero(estimate(sketch[a:b], sketch[x]) >= MIN_ESTIMATE)
                for y in others.tolist():
                    if y != x and forest.union(-1 if near[y] else y, x):
                        found.add((int(node[x]), int(node[y])))
        if len(found) > 200_000:
            yield _edge_batch(found)
            found = set()
    yield _edge_batch(found)


def _edge_batch(found: set[tuple[int, int]]) -> pa.RecordBatch:
    pairs = sorted(p for p in found if p[0] != p[1])
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])


def exact_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs with 100 * intersection >= percent * union, over all pairs of the sets.

    Walks each component breadth first: a set that is taken up is compared with all that aren't yet reached, through lists of
    the sets that have a shingle; the lists are made anew when half of the sets have been reached.
    """
    size = np.array([len(s) for s in sets])
    open_ = np.ones(len(sets), bool)
    out: list[tuple[int, int]] = []
    held, lists = 0, None

    def index():
        ids = np.flatnonzero(open_)
        flat = np.concatenate([sets[i] for i in ids]) if len(ids) else np.zeros(0, U)
        owner = np.repeat(ids, size[ids])
        order = np.argsort(flat, kind="stable")
        return flat[order], owner[order]

    for start in range(len(sets)):
        if not open_[start]:
            continue
        open_[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            left = int(open_.sum())
            if not left:
                break
            if lists is None or left * 2 < held:
                lists, held = index(), left
            flat, owner = lists
            lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
            n = hi - lo
            some = np.flatnonzero(n)
            if not len(some):
                continue
            take = np.repeat(lo[some] - np.concatenate(([0], np.cumsum(n[some])[:-1])), n[some]) + np.arange(int(n[some].sum()))
            common = np.bincount(owner[take], minlength=len(sets))
            near = np.flatnonzero(open_ & (common > 0) & (100 * common >= percent * (size + size[x] - common)))
            open_[near] = False
            out += [(x, int(y)) for y in near]
            queue += near.tolist()
    return out


def _link_exactly(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (hood, i, j, node, shingles), a group's together: the exact links' forest."""
        for table in _groups(batches, 3):
            bounds = _bounds(table, 3)
            node, found = table.column("node").to_numpy(), set()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a > 1:
                    sets = [np.frombuffer(x.as_buffer(), U) for x in table.column("shingles").slice(a, b - a)]
                    found.update((int(node[a + x]), int(node[a + y])) for x, y in exact_links(sets, percent))
            yield _edge_batch(found)

    return run


def _components(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (signatures), and of each distinct set _d1, _d2, with its component's smallest id and first row: _component, _first."""
    small_batches(docs.sparkSession)
    rows = cut(signatures(docs, words, id_col, text_col))
    # One node for each distinct set. Of its rows the one of smallest id (nulls last), then the first, speaks for it.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("anon"), "doc_id", "row", "mark", "n_shingles", "bands", "sketch")).alias("x")
    classes = cut(rows.where("n_shingles > 0").groupBy("d1", "d2").agg(best).select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "x.*"))
    keys = classes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(apart("key").alias("_key"), F.ceil(F.col("n") / BUCKET_BLOCK).alias("blocks"))
    met = keys.join(shared.hint("shuffle_merge"), F.col("key") == F.col("_key")).select("key", "node", "blocks")
    sketched = blocked(met, "key", "node", "blocks").join(classes.select(F.col("node").alias("_node"), "sketch").hint("shuffle_merge"), F.col("node") == F.col("_node")).select("key", "i", "j", "node", "sketch")
    forest = sketched.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(_bucket_forest, "u long, v long")
    inner = components(forest)
    hoods = cut(inner.unionByName(inner.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("component", "hood"))
    links = cut(components(_confirmed(docs, classes, hoods, words, percent, id_col, text_col)))
    # The rows that speak for the members of a component, and the best of them.
    members = links.unionByName(links.select(F.col("component").alias("node"), "component").distinct())
    spoken = members.join(classes.select(F.col("node").alias("_node"), "anon", "doc_id", "row").hint("shuffle_merge"), F.col("node") == F.col("_node"))
    lead = spoken.groupBy("component").agg(F.min(F.struct("anon", "doc_id", "row")).alias("lead")).select(apart("component").alias("_of"), "lead")
    led = members.join(lead.hint("shuffle_merge"), F.col("component") == F.col("_of")).select(F.col("node").alias("_member"), "lead")
    own = F.struct("anon", "doc_id", "row")
    named = classes.join(led.hint("shuffle_merge"), F.col("node") == F.col("_member"), "left").select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.coalesce("lead", own).alias("lead"))
    return rows, named.select("_d1", "_d2", F.col("lead.doc_id").alias("_component"), F.col("lead.row").alias("_first"))


def _placed(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, first (whether the row leads its component; rows of empty set do)."""
    rows, named = _components(docs, words, percent, id_col, text_col)
    out = rows.select("doc_id", "mark", "row", "n_shingles", "d1", "d2").join(named.hint("shuffle_merge"), (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("n_shingles") > 0), "left")
    empty = F.col("n_shingles") == 0
    return out.select("doc_id", "mark", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("_component")).alias("component_id"), (empty | (F.col("row") == F.col("_first"))).alias("first"))


def near_dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    placed = _placed(docs, words, percent, id_col, text_col)
    kept = F.when(F.col("component_id").isNull(), F.col("first")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return placed.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _confirmed(docs: DataFrame, classes: DataFrame, hoods: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Edges of the exact links inside neighbourhoods (node, hood)."""
    members = hoods.join(classes.select(F.col("node").alias("_node"), "n_shingles", F.col("mark").alias("_mark")).hint("shuffle_merge"), F.col("node") == F.col("_node")).drop("_node")
    sizes = members.groupBy("hood").agg(F.ceil(F.sum("n_shingles") / SET_BLOCK).alias("blocks")).select(apart("hood").alias("_hood"), "blocks")
    sized = cut(members.join(sizes.hint("shuffle_merge"), F.col("hood") == F.col("_hood")).drop("_hood"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hood", "blocks", "node", "shingles"]
        for batch in batches:
            for first, hashed, bounds in column_sets(batch.column("text"), words):
                n = len(bounds) - 1
                data = pa.array([hashed[bounds[i] : bounds[i + 1]].tobytes() for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, n) for c in names[:3]), data], names)

    texts = docs.select(text_mark(F.col(id_col).cast("long"), F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    asked = sifted(texts, "mark", sieve(sized.select(F.col("_mark").alias("mark")), "mark"))
    # Repeated rows share a mark and a text; one of them is enough.
    met = asked.join(sized.hint("shuffle_merge"), F.col("mark") == F.col("_mark")).dropDuplicates(["mark"]).select("hood", "blocks", "node", "text")
    found = met.mapInArrow(sets, "hood long, blocks long, node long, shingles binary")
    dealt = blocked(found, "hood", "node", "blocks").select("hood", "i", "j", "node", "shingles")
    return dealt.repartition("hood", "i", "j").sortWithinPartitions("hood", "i", "j", "node").mapInArrow(_link_exactly(percent), "u long, v long")


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns, and all documents of empty set."""
    mark = fresh(docs, "mark")
    stays = _placed(docs, words, percent, id_col, text_col).where("first and n_shingles > 0").select(F.col("mark").alias("_mark"))
    blank = F.translate(F.coalesce(F.col(text_col), F.lit("")), WHITE, "") == ""
    marked = docs.where(~blank).withColumn(mark, text_mark(F.col(id_col).cast("long"), F.col(text_col)))
    kept = marked.join(stays.hint("shuffle_merge"), marked[mark] == stays["_mark"], "left_semi").dropDuplicates([mark]).select(docs.columns)
    return kept.unionByName(docs.where(blank))
