import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boundwell.llm import suffix_dedup as S
from tests.llm import brute

DOC = "doc_id long, text string"


def passages(seed=1, n=40):
    """Texts that share passages, cut and edited at random places."""
    rng = random.Random(seed)
    pool = [brute.prose(rng, rng.randrange(40, 120)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            a, b = sorted(rng.randrange(len(p)) for _ in range(2))
            parts += [brute.prose(rng, rng.randrange(0, 30)), p[a:b]]
        docs.append((i, "\n".join(parts)))
    return docs


def result(rows):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


@pytest.mark.parametrize(("length", "seed"), [(40, 1), (40, 2), (200, 3), (64, 4)])
def test_same_as_all_windows_counted(spark, length, seed):
    docs = passages(seed)
    got = S.suffix_dedup(spark.createDataFrame(docs, DOC), length=length).collect()
    assert result(got) == sorted(brute.repeats(docs, length))
    assert sum(r.n_removed for r in got) > 0


def test_large_groups_are_counted_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 1)
    docs = passages(5)
    got = S.suffix_dedup(spark.createDataFrame(docs, DOC), length=40).collect()
    assert result(got) == sorted(brute.repeats(docs, 40))


def test_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 300)
    docs = [*passages(6, 15), (90, brute.prose(random.Random(9), 900)), (91, brute.prose(random.Random(9), 700)), (92, "ab" * 1500)]
    got = S.suffix_dedup(spark.createDataFrame(docs, DOC), length=40).collect()
    assert result(got) == sorted(brute.repeats(docs, 40))


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 5000), (5, "é" * 150), (6, "x" * 199), (7, "x" * 200), (8, "x" * 201), (9, "twin " * 100), (9, "twin " * 100), (None, "twin " * 100), (10, "".join(chr(97 + i % 26) + str(i) for i in range(100)))]
    docs = spark.createDataFrame([(*r, 5, "k") for r in rows], DOC + ", n_chars int, key string")
    got = S.suffix_dedup(docs).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(key, (tuple(r)[:5] for r in got))) == sorted(map(key, brute.repeats(rows, 200)))
    left = S.drop_repeats(docs)
    assert left.columns == docs.columns
    by = {r.doc_id: r for r in left.collect()}
    assert by[4].text == "" and by[4].n_chars == 0 and by[3].text == "short" and by[1].text is None and by[10].n_chars == len(by[10].text)
    assert S.suffix_dedup(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=30), min_size=1, max_size=12))
def test_suffix_order_by_hashes(texts):
    data = "".join(texts).encode()
    suffixes = S.Suffixes(np.frombuffer(data + bytes(64), np.uint8))
    at = np.arange(len(data))
    limit = np.full(len(data), 40)
    padded = data + bytes(64)
    order = suffixes.order(np.zeros(len(data), np.int64), at, limit)
    assert [padded[i : i + 40] for i in order] == sorted(padded[i : i + 40] for i in at)


def test_a_hash_collision_does_not_decide(monkeypatch):
    buf = np.frombuffer(b"abcdefgh" + b"abcdXfgh" + bytes(8), np.uint8)
    suffixes = S.Suffixes(buf)
    monkeypatch.setattr(suffixes.hashes, "of", lambda a, b: np.zeros(len(a), np.uint64))  # everything collides
    group, at = np.zeros(2, np.int64), np.array([0, 8])
    assert len(set(suffixes.classes(group, at, np.array([8, 8]), True).tolist())) == 2


def test_periodic_runs_send_few_rows_and_lose_nothing(spark):
    rng = random.Random(4)
    unit = brute.prose(rng, 12)
    run = [(1, "a" * 3000), (2, "z" + "a" * 200), (3, "b" * 199), (4, "b" * 200), (5, unit * 60), (6, "tail" + (unit * 60)[37:260] + "end"), (7, brute.prose(rng, 80) + "ab" * 900 + brute.prose(rng, 80)), (8, "q" + "ba" * 100), (9, "x" * 450 + "y" * 450), (10, "é" * 700)]
    docs = spark.createDataFrame(run, DOC)
    assert result(S.suffix_dedup(docs).collect()) == sorted(brute.repeats(run, 200))
    big = spark.range(1).select(S.F.lit(1).cast("long").alias("key"), S.F.expr("repeat('a', cast(id + 5000000 AS INT))").alias("text"))
    assert S.anchors(big, 200).count() < 20_000


def test_a_run_of_fifty_megabytes(spark):
    docs = spark.range(1).select(S.F.col("id").alias("doc_id"), S.F.expr("concat('start', repeat('ab', cast(id + 25000000 AS INT)), 'stop')").alias("text"))
    (r,) = S.suffix_dedup(docs).collect()
    assert (r.n_bytes, r.n_removed, r.n_spans) == (50_000_009, 50_000_000, 1)


def test_rows_that_share_a_hash_are_told_apart(spark, monkeypatch):
    docs = passages(7, 25)
    monkeypatch.setattr(S, "_hashes", lambda doc_id, text: (S.F.pmod(S.F.xxhash64(doc_id), S.F.lit(3)), S.F.xxhash64(doc_id, text)))
    got = S.suffix_dedup(spark.createDataFrame(docs, DOC), length=40).collect()
    assert result(got) == sorted(brute.repeats(docs, 40))


@pytest.mark.parametrize("group", [1, 3, 10])
def test_groups_are_halved_until_they_are_small(spark, monkeypatch, group):
    """The same frequent string in many contexts, of which some agree in parts."""
    monkeypatch.setattr(S, "GROUP", group)
    rng = random.Random(11)
    core, sides = brute.prose(rng, 12)[:45], [brute.prose(rng, 12)[:40] for _ in range(4)]
    docs = [(i, brute.prose(rng, 5) + rng.choice(sides)[rng.randrange(20) :] + core + rng.choice(sides)[: rng.randrange(40)] + brute.prose(rng, 5)) for i in range(40)]
    got = S.suffix_dedup(spark.createDataFrame(docs, DOC), length=50).collect()
    assert result(got) == sorted(brute.repeats(docs, 50))


def test_colliding_anchor_hashes_decide_nothing(spark, monkeypatch):
    """With one value for all hashes of anchor strings only the digests and the byte check of the sort are left."""
    docs = [(1, "a" * 10 + "Q" * 30 + "b" * 10), (2, "c" * 10 + "R" * 30 + "d" * 10), (3, "a" * 10 + "Q" * 30 + "e" * 10)]
    table = [(h, 0, 0, k, 0, 10, True, t.encode()) for h, (k, t) in zip((7, 7, 7), docs, strict=True)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in table], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], ["h", "lo", "hi", "key", "pos", "l", "alone", "context"])
    batch = batch.set_column(2, "hi", pa.array([30] * 3, pa.int32()))
    (out,) = S._sort_contexts(40)(iter([batch]))
    assert sorted(out.column("key").to_pylist()) == [1, 3]


def test_groups_of_different_limits_are_sorted_together():
    """A group of long suffixes beside one of short ones at the end of the buffer."""
    rng = random.Random(6)
    data = bytes(rng.choice(b"ab") for _ in range(400))
    group = np.repeat([0, 1, 2], [37, 50, 21])
    limit = np.array([90, 12, 60])[group]
    at = np.concatenate([rng.sample(range(300), 37), rng.sample(range(330, 388), 50), rng.sample(range(340), 21)])
    order = S.Suffixes(np.frombuffer(data, np.uint8)).order(group, at, limit)
    for g in (0, 1, 2):
        own = [i for i in order.tolist() if group[i] == g]
        assert [data[at[i] : at[i] + limit[i]] for i in own] == sorted(data[at[i] : at[i] + limit[i]] for i in np.flatnonzero(group == g))
