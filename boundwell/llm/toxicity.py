"""Toxicity by maximum-scoring segments of token log-odds.

Training counts, for features (a word and its prefixes of PREFIXES bytes), the toxic and the clean labelled documents that have
them; those whose likelihood ratio is significant are candidates, and all documents are counted for the candidates' Dirichlet
prior.  A token takes the log-odds of its most significant feature, or none, less a constant drift, so that clean text drifts
down.  One linear scan finds every maximal-scoring segment of a document.  Under the null hypothesis segments of a text of n
tokens follow an extreme-value law: a score s has K n exp(-lambda s) chance equals, and the r best together a known tail
(Karlin and Altschul's sum statistic); lambda solves the moment equation over the clean documents' token scores, K is set from
their segments, and a logistic curve over the training documents' tail probabilities gives the score.  Copies would count as
independent evidence, so of training documents of equal text and label one counts.

At most LABEL_SAMPLE labelled rows train (a hash of the id picks them if there are more); their texts are the training table, and
what is broadcast and collected is bounded by it: their significant features, one row of a fixed table each, and their segments'
scores.  A feature is a slot of 2**BITS and a check of CHECK bits; a token whose check isn't the slot's has no feature there, so
that unseen words don't take a toxic word's score.  Corpus counts are summed by feature in the JVM; a task sends one row for each candidate.

Defined results: null and empty texts score as a text without tokens; null labels don't train; of repeated labels of an id the
highest counts; without labels of both kinds every score is 0 (predicted 0); repeated rows each get a row; an empty table
gives an empty result; lang, source, id and labels are not inputs of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwell.llm.bytehash import PrefixHash, packed, runs, slices
from boundwell.llm.runtime import cut, small_batches

BITS, CHECK = 20, 24
PREFIXES = (4, 5, 6, 7)
#: Labelled rows that train, at most.
LABEL_SAMPLE = 100_000
#: The prior's weight, as a part of the counts of the smaller class.
PRIOR_PART = 0.2
#: Least square root of the likelihood ratio, and least log-odds, of a feature that scores.
MIN_SIGNIFICANCE = 4.5
MIN_ODDS = 1.5
DRIFT = 0.5
CLIP = 6.0

TOKEN_BYTE = np.zeros(256, bool)
TOKEN_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = True


def column_tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """tokens() of a string column, a slice at a time."""
    for start, texts in slices(column):
        for first, *rest in tokens(texts):
            yield start + first, *rest


def tokens(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """For slices of texts: the first's index, the document of each token, its features (equal-length arrays, -1: none), and each document's number of tokens."""
    for first, buf, starts, _ in packed([t.lower() for t in texts]):
        s, e = runs(TOKEN_BYTE[buf])
        doc = np.searchsorted(starts, s, side="right") - 1
        hashes = PrefixHash(buf)
        size = e - s
        slots, checks = [], []
        for n in (None, *PREFIXES):
            have = np.ones(len(s), bool) if n is None else size > n
            at = s[have]
            # A prefix and a word of the same letters are features of their own.
            h = hashes.mixed(at, e[have]) if n is None else hashes.mixed(at, at + n) * np.uint64(0xD6E8FEB86659FD93)
            slot, check = np.full(len(s), -1, np.int64), np.full(len(s), -1, np.int64)
            slot[have] = (h >> np.uint64(64 - BITS)).astype(np.int64)
            check[have] = (h >> np.uint64(64 - BITS - CHECK)).astype(np.int64) & ((1 << CHECK) - 1)
            slots.append(slot)
            checks.append(check)
        yield first, doc, slots + checks, np.bincount(doc, minlength=len(starts))


def _numbers(features: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Of each kind of feature the tokens' numbers, slot and check together; -1: none."""
    half = len(features) // 2
    for slot, check in zip(features[:half], features[half:], strict=True):
        yield np.where(slot < 0, -1, slot << CHECK | check)


def _once(doc: np.ndarray, features: list[np.ndarray], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature number), each pair once; with `wanted` (sorted) only those."""
    pairs = []
    for f in _numbers(features):
        ok = f >= 0
        if wanted is not None:
            at = np.minimum(np.searchsorted(wanted, f), len(wanted) - 1)
            ok &= wanted[at] == f
        pairs.append(np.unique((doc[ok] << (BITS + CHECK)) | f[ok]))
    both = np.concatenate(pairs)
    return both >> (BITS + CHECK), both & ((1 << (BITS + CHECK)) - 1)


#: Features that a task counts before it hands them on.
TASK_FEATURES = 1 << 20


def _count_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) to rows (feature, toxic, clean): how many of a task's documents have it."""
    held, size = [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        number, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return number, np.stack([np.bincount(at, np.concatenate([h[1][k] for h in held]), len(number)).astype(np.int64) for k in (0, 1)])

    def told() -> pa.RecordBatch:
        number, (toxic, clean) = summed()
        return pa.RecordBatch.from_arrays([pa.array(number), pa.array(toxic), pa.array(clean)], ["feature", "toxic", "clean"])

    for batch in batches:
        label = batch.column("toxic").to_numpy().astype(np.int64)
        for first, doc, features, _ in column_tokens(batch.column("text")):
            of, feature = _once(doc, features)
            number, at = np.unique(feature, return_inverse=True)
            toxic = np.bincount(at, label[first + of], len(number)).astype(np.int64)
            held.append((number, np.stack([toxic, np.bincount(at, minlength=len(number)) - toxic])))
            size += len(number)
            if size > 2 * TASK_FEATURES:
                held = [summed()]
                size = len(held[0][0])
                if size > TASK_FEATURES:
                    yield told()
                    held, size = [], 0
    if held:
        yield told()


def _count_everywhere(candidates: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts to a row (feature, n) for each candidate, and a row of null for the features of all documents."""
        n, total = np.zeros(len(candidates), np.int64), 0
        for batch in batches:
            for _, doc, features, _ in column_tokens(batch.column("text")):
                n += np.bincount(np.searchsorted(candidates, _once(doc, features, candidates)[1]), minlength=len(n))
                total += sum(int((f >= 0).sum()) for f in features[: len(features) // 2])
        yield pa.RecordBatch.from_arrays([pa.array([*candidates.tolist(), None], pa.int64()), pa.array([*n.tolist(), total], pa.int64())], ["feature", "n"])

    return run


def significance(toxic: Column, clean: Column, share: float) -> Column:
    """Square root of the likelihood ratio of a feature's counts against the classes' shares."""
    both = toxic + clean
    term = lambda x, part: F.when(x > 0, x * F.log(x / (both * part))).otherwise(0.0)
    return F.sqrt(2 * F.greatest(term(toxic, share) + term(clean, 1 - share), F.lit(0.0)))


def log_odds(everywhere: np.ndarray, toxic: np.ndarray, clean: np.ndarray, total: int, all_toxic: int, all_clean: int) -> np.ndarray:
    """The clipped log-odds ratio, toxic to clean, of each feature; 0 where it is small. total: features of all documents."""
    weight = PRIOR_PART * min(all_toxic, all_clean)
    prior = weight * (everywhere + 1e-3) / (total + 1e-3 * (1 << BITS))
    a, b = toxic + prior, clean + prior
    delta = np.log(a / (all_toxic + weight - a)) - np.log(b / (all_clean + weight - b))
    return np.where(np.abs(delta) >= MIN_ODDS, np.clip(delta, -CLIP, CLIP), 0.0)


def score_table(numbers: np.ndarray, odds: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """By slot: log-odds, significance, check. Of features that share a slot the most significant has it."""
    out = np.zeros((3, 1 << BITS), np.float32)
    order = np.argsort(strength, kind="stable")
    order = order[odds[order] != 0]
    slot = numbers[order] >> CHECK
    out[0, slot], out[1, slot], out[2, slot] = odds[order], strength[order], numbers[order] & ((1 << CHECK) - 1)
    return out


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in one pass (Ruzzo and Tompa).

    Each open segment keeps the place of the nearest one before it that has a smaller sum to its left. A new segment looks along
    these places, and one that it joins with leaves the list, so that the steps are bounded by the number of segments.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, sum before it, sum through it, nearest smaller before it
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left, j = i, before, len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((start, i + 1, left, total, j))
                break
            start, _, left, _, up = kept[j]
            del kept[j:]
            j = up
    return [(a, b, right - left) for a, b, left, right, _ in kept]


def token_scores(features: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Each token's score: its most significant feature's log-odds, less the drift. A table without checks takes every feature of a slot."""
    half = len(features) // 2
    best_z = best = np.zeros(len(features[0]), np.float32)
    for slot, check in zip(features[:half], features[half:], strict=True):
        own = slot >= 0 if len(table) < 3 else (slot >= 0) & (table[2][slot] == check)
        z = np.where(own, table[1][slot], 0.0)
        better = z > best_z
        best_z, best = np.where(better, z, best_z), np.where(better, table[0][slot], best)
    return best - np.float32(DRIFT)


def column_segments(column: pa.Array, table: np.ndarray, with_histogram: bool = False):
    """segments_of() of a string column, a slice at a time."""
    parts = [segments_of(texts, table, with_histogram) for _, texts in slices(column)]
    if with_histogram:
        return [x for p in parts for x in p[0]], [x for p in parts for x in p[1]]
    return [x for p in parts for x in p]


def segments_of(texts: list[bytes], table: np.ndarray, with_histogram: bool = False):
    """For each text: its number of tokens and its maximal segments, as (first token, end, score); and a histogram of all scores, in tenths."""
    out: list[tuple[int, list[tuple[int, int, float]]]] = []
    histogram: dict[int, np.ndarray] = {}
    for first, doc, features, sizes in tokens(texts):
        score = token_scores(features, table)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        plus = np.flatnonzero(score > 0)
        sums = np.concatenate(([0.0], np.cumsum(score, dtype=float)))
        bounds = np.searchsorted(plus, begin)
        for i in range(len(sizes)):
            p = plus[bounds[i] : bounds[i + 1]]
            found = []
            if len(p):
                # Runs of falling tokens between two rising ones are one falling step.
                edge = np.stack([p, p + 1], 1).ravel()
                steps = np.diff(sums[edge])
                found = [(int(edge[a] - begin[i]), int(edge[b] - begin[i]), float(s)) for a, b, s in maximal_segments(steps.tolist())]
            out.append((int(sizes[i]), found))
            if with_histogram:
                histogram[first + i] = np.bincount(np.clip(np.rint(score[begin[i] : begin[i + 1]] * 10) + 70, 0, 140).astype(int), minlength=141)
    return (out, [histogram[i] for i in range(len(texts))]) if with_histogram else out


@dataclass
class Model:
    table: np.ndarray
    decay: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    bias: float = -20.0
    info: dict = field(default_factory=dict)

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        """-log of the least chance, over r, that a clean text's r best segments are as good together; 0 without segments."""
        base = math.log(self.k * max(n, 1))
        best = total = 0.0
        for r, s in enumerate(sorted((x[2] for x in segments), reverse=True), 1):
            total += self.decay * s - base
            if r == 1:
                best = -math.log(max(-math.expm1(-math.exp(min(50.0, -total))), 1e-300)) if total < 600 else total
            elif total > r:
                best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
        return best

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * evidence + self.bias))))

    def passages(self, n: int, segments: list[tuple[int, int, float]], least: float = 0.01) -> list[tuple[int, int, float]]:
        """The significant segments: (first token, end, E-value) with E at most least."""
        e = [(a, b, self.k * max(n, 1) * math.exp(-self.decay * s)) for a, b, s in segments]
        return [x for x in e if x[2] <= least]


def _moment_root(histogram: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 for a falling score distribution (tenths from -7)."""
    p, s = histogram / max(1, histogram.sum()), (np.arange(len(histogram)) - 70) / 10
    if not (p[s > 0]).any():
        return 1.0
    lo, hi = 1e-3, 20.0
    f = lambda x: float((p * np.exp(np.clip(x * s, -700, 700))).sum()) - 1
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if f(mid) > 0 else (mid, hi)
    return max(0.05, lo)


def fit(table: np.ndarray, rows: list[tuple[int, int, np.ndarray]], histogram: np.ndarray) -> Model:
    """rows: (toxic, tokens, its segments' scores) of the training documents; histogram: the clean ones' token scores."""
    model = Model(table)
    if not any(r[0] for r in rows) or all(r[0] for r in rows):
        return model
    model.decay = _moment_root(histogram)
    clean = [(n, s) for y, n, s in rows if not y]
    # K such that the law expects as many segments of a word's strength or more as the clean documents have.
    least = MIN_ODDS
    seen = sum(1 for _, s in clean for x in s if x >= least) + 0.5
    model.k = seen / (sum(max(n, 1) for n, _ in clean) * math.exp(-model.decay * least))
    x = np.array([model.evidence(n, [(0, 0, v) for v in s]) for _, n, s in rows])
    y = np.array([r[0] for r in rows], float)
    mean, scale = x.mean(), x.std() + 1e-9
    u, a, b = (x - mean) / scale, 0.0, math.log(y.mean() / (1 - y.mean()))
    for _ in range(60):  # Newton steps of a logistic fit with a little shrinkage
        q = 1 / (1 + np.exp(-np.clip(a * u + b, -40, 40)))
        w = q * (1 - q) + 1e-9
        g = np.array([((y - q) * u).sum() - 1e-2 * a, (y - q).sum()])
        h = np.array([[(w * u * u).sum() + 1e-2, (w * u).sum()], [(w * u).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a + max(-1.0, min(1.0, step[0])), b + max(-1.0, min(1.0, step[1]))
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.bias = a / scale, b - a * mean / scale
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(labels: DataFrame, id_col: str, label_col: str, bound: int) -> DataFrame:
    """At most about bound labelled training rows (label_id, toxic): all, or those whose id's hash is low."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    n = rows.count()
    return rows if n <= bound else rows.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int((1 << 30) * bound / n))


def training_table(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(text, toxic) of the labelled rows that train, of equal text and label one: at most `sample` ids."""
    # At most `sample` rows of two numbers are broadcast, first all that are picked, then those whose text is the first of its kind.
    picked = F.broadcast(cut(_sample(labels, id_col, label_col, sample)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = texts.join(picked, F.col("id") == F.col("label_id")).select("label_id", "toxic", F.sha2("text", 256).alias("signature"))
    unlike = cut(signed.groupBy("signature", "toxic").agg(F.min("label_id").alias("label_id")).select("label_id", "toxic").distinct())
    return cut(texts.join(F.broadcast(unlike), F.col("id") == F.col("label_id")).select("text", "toxic"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = LABEL_SAMPLE) -> Model:
    """labels: id_col and label_col (0 or 1)."""
    small_batches(docs.sparkSession)
    training = training_table(docs, labels, id_col, text_col, label_col, sample)
    counts = cut(training.select("text", F.least(F.greatest("toxic", F.lit(0)), F.lit(1)).alias("toxic")).mapInArrow(_count_labelled, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    all_toxic, all_clean = (int(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    if not all_toxic or not all_clean:
        return Model(np.zeros((3, 1 << BITS), np.float32))
    strength = significance(F.col("toxic"), F.col("clean"), all_toxic / (all_toxic + all_clean))
    picked = counts.withColumn("z", strength).where(F.col("z") >= MIN_SIGNIFICANCE).orderBy("feature").collect()
    numbers, toxic, clean, z = (np.array([r[c] for r in picked], t) for c, t in (("feature", np.int64), ("toxic", float), ("clean", float), ("z", float)))
    table = np.zeros((3, 1 << BITS), np.float32)
    if len(numbers):
        everywhere = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_everywhere(numbers), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
        found = {r["feature"]: r["n"] for r in everywhere.collect()}  # a row for each candidate, and the total
        table = score_table(numbers, log_odds(np.array([found[f] for f in numbers.tolist()], float), toxic, clean, found[None], all_toxic, all_clean), z)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram = np.zeros(141, np.int64)
        names = ["toxic", "n", "scores", "histogram"]
        for batch in batches:
            label = batch.column("toxic").to_pylist()
            found, each = column_segments(batch.column("text"), shared.value, with_histogram=True)
            for y, h in zip(label, each, strict=True):
                histogram += 0 if y else h
            scores = [np.array([x[2] for x in s], "<f8").tobytes() for _, s in found]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array([n for n, _ in found], pa.int64()), pa.array(scores, pa.binary()), pa.nulls(len(found), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([histogram.tobytes()], pa.binary())], names)

    rows, histogram = [], np.zeros(141, np.int64)
    for y, n, scores, h in training.mapInArrow(segments, "toxic int, n long, scores binary, histogram binary").collect():
        if h is None:
            rows.append((y, n, np.frombuffer(scores, "<f8")))
        else:
            histogram += np.frombuffer(h, np.int64)
    return fit(table, rows, histogram)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.01) -> DataFrame:
    """doc_id, score, predicted, passages (first token, end, e_value) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    passage = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("e_value", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = column_segments(batch.column("text"), m.table)
            p = [m.probability(m.evidence(n, s)) for n, s in found]
            hot = [[{"first": a, "end": b, "e_value": e} for a, b, e in m.passages(n, s, least)] for n, s in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(hot, passage)], ["doc_id", "score", "predicted", "passages"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, f"doc_id {kind}, score double, predicted int, passages array<struct<first:int,end:int,e_value:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = LABEL_SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, passages."""
    model = train(docs, labels, id_col, text_col, label_col, sample)
    return score_texts(docs, model, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = LABEL_SAMPLE) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, scored as they stream by."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, sample))
    k = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = column_segments(batch.column(k), m.table)
            yield batch.filter(pa.array([m.probability(m.evidence(n, s)) < 0.5 for n, s in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
