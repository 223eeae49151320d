import random

import numpy as np
import pytest

from boundwell.llm import near_dedup as N
from tests.llm import brute

DOC = "doc_id long, text string"


def corpus(seed=3, groups=6, copies=12, words=60):
    rng = random.Random(seed)
    docs = {}
    for _ in range(groups):
        base = brute.prose(rng, words).split(" ")
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = brute.prose(rng, 1)
            docs[len(docs) * 3 + 1] = " ".join(w)
    for _ in range(20):
        docs[len(docs) * 3 + 1] = brute.prose(rng, rng.randrange(1, 30))
    return docs


@pytest.mark.parametrize("words", [2, 5])
def test_components_are_those_of_all_pairs(spark, words):
    docs = corpus()
    got = N.near_dedup(spark.createDataFrame(list(docs.items()), DOC), words=words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(docs, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(N, "SET_BLOCK", 150)
    docs = corpus(seed=5)
    got = N.near_dedup(spark.createDataFrame(list(docs.items()), DOC), words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(docs, 2)


def test_exact_links_at_the_threshold():
    a = np.arange(9, dtype=np.uint64)
    assert N.exact_links([a, a[:8], a[1:9][:7]], 80) and len(N.exact_links([a[:5], a[:4]], 80)) == 1  # 4 of 5
    assert N.exact_links([a[:5], np.array([0, 1, 2, 7], np.uint64)], 80) == []


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(0)
    for share in (0.6, 0.8, 0.95):
        sets = []
        for _ in range(200):
            common = rng.integers(1, 1 << 63, int(400 * share), dtype=np.uint64)
            rest = 400 - len(common)
            sets += [np.concatenate([common, rng.integers(1, 1 << 63, rest // 2, dtype=np.uint64)]) for _ in range(2)]
        bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        sketch = N.odd_sketch(N.minhash(np.concatenate(sets), bounds))
        j = len(common) / (2 * len(sets[0]) - len(common))
        assert abs(N.estimate(sketch[::2], sketch[1::2]).mean() - j) < 0.02


def test_edge_cases(spark):
    long_ = brute.prose(random.Random(1), 30_000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "WORD"), (6, "a b"), (7, "a  b"), (8, long_), (9, long_ + " tail"), (None, "a b"), (None, "alone here"), (6, "a b")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], DOC + ", node string, key int")
    got = N.near_dedup(docs, words=2).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [(by[k].n_shingles, by[k].component_id, by[k].kept) for k in (1, 2, 3)] == [(0, 1, True), (0, 2, True), (0, 3, True)]
    assert (by[4].n_shingles, by[5].component_id, by[7].component_id, by[9].component_id) == (1, 4, 6, 8)
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["6", "None"]
    kept = N.drop_near_copies(docs)
    assert kept.columns == docs.columns and 9 not in [r.doc_id for r in kept.collect()]
    assert N.near_dedup(docs.limit(0)).count() == 0
    assert N.drop_near_copies(docs.limit(0)).count() == 0


def test_all_64_bit_ids(spark):
    """Ids from one end of the range to the other, against all pairs; and drop_near_copies."""
    docs = corpus(seed=8)
    rng = random.Random(8)
    wide = [-(1 << 63), -(1 << 62), -1, 0, 1 << 61, 1 << 62, (1 << 62) + 5, (1 << 62) + 6, (1 << 63) - 1]
    ids = wide + [rng.randrange(-(1 << 63), 1 << 63) for _ in range(len(docs) - len(wide))]
    rng.shuffle(ids)
    docs = dict(zip(ids, docs.values(), strict=True))
    want = brute.near(docs, 2)
    frame = spark.createDataFrame(list(docs.items()), DOC)
    got = N.near_dedup(frame, words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert {r.doc_id for r in N.drop_near_copies(frame, words=2).collect()} == {k for k, (_, c) in want.items() if k == c}


def test_rows_without_id_are_searched_and_dropped(spark):
    rng = random.Random(2)
    a, b, c = (brute.prose(rng, 80) for _ in range(3))
    rows = [(1, a), (None, a), (None, a + " x"), (None, b), (None, b), (None, b + " y"), (7, c + " left"), (None, c), (9, c + " x"), (None, None), (None, " ")]
    docs = spark.createDataFrame(rows, DOC)
    got = N.near_dedup(docs, words=2).collect()
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["1", "1", "7", "None", "None", "None", "None", "None"]
    assert [r.kept for r in got if r.component_id == 1 and r.doc_id is None] == [False, False]
    assert sum(r.kept for r in got if r.component_id is None and r.n_shingles) == 1
    kept = N.drop_near_copies(docs, words=2).collect()
    assert sorted(str(r.doc_id) for r in kept if (r.text or "").strip()) == ["1", "7", "None"]
    assert sum(not (r.text or "").strip() for r in kept) == 2
