import numpy as np
import pytest

from boundwell.llm import embedding_dedup as E
from tests.llm import brute

VEC = "vec_id long, embedding array<float>, label int"


def brute_links(rows):
    links, union = {r[0]: 0 for r in rows}, brute.Union([r[0] for r in rows])
    for label in {r[2] for r in rows} - {None}:
        some = [(k, np.array(v, np.float32).astype(float)) for k, v, y in rows if y == label and v]
        m = E.unit(np.array([v for _, v in some]))
        near = m @ m.T >= 0.98
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            a, b = some[i][0], some[j][0]
            links[a] += 1
            links[b] += 1
            union.join(a, b)
    return {k: (links[k], union.find(k)) for k in links}


def vectors(seed=0, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(12):
        base = rng.standard_normal(dim)
        for _ in range(25):
            rows.append((len(rows) + 5, (base + rng.standard_normal(dim) * np.linalg.norm(base) / np.sqrt(dim) * rng.uniform(0, 0.2)).astype(np.float32).tolist(), len(rows) % 2))
    rows += [(len(rows) + 5 + i, rng.standard_normal(dim).astype(np.float32).tolist(), 0) for i in range(50)]
    return rows


def test_links_and_components_are_those_of_all_pairs(spark):
    rows = vectors()
    got = E.embedding_dedup(spark.createDataFrame(rows, VEC)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(E, "STORED_BLOCK", 4)
    monkeypatch.setattr(E, "PROBE_BLOCK", 7)
    rows = vectors(1, 16)
    got = E.embedding_dedup(spark.createDataFrame(rows, VEC)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = E.unit(rng.standard_normal((1500, 64)))
    z = rng.standard_normal(x.shape)
    z = E.unit(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z
    found = []
    for a, b in ((x, y), (y, x)):
        row, direction, _ = E.decode_caps(a, E.REACH)
        best = E.decode_caps(b, 0.0)[2]
        caps = set(zip(row.tolist(), direction.tolist(), strict=True))
        found.append([(i, d) in caps for i, d in enumerate(best.tolist())])
    assert np.logical_or(*found).mean() > 0.998


def test_caps_are_decoded_completely():
    x = E.unit(np.random.default_rng(3).standard_normal((20, 8)))
    row, direction, best = E.decode_caps(x, 0.3)
    everything = E.direction_scores(x, np.arange(E.CODES**E.BLOCKS))
    top = everything.max(1)
    assert (everything.argmax(1) == best).all()
    assert len(row) == int((everything >= top[:, None] - 0.3 - 1e-12).sum())


def test_edge_cases(spark):
    one = [1.0] + [0.0] * 7
    rows = [(1, one, 1), (2, one, 1), (3, [2.0] + [0.0] * 7, 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [0.0] * 8, 1), (8, [None] + [1.0] * 7, 1), (9, [float("nan")] + [1.0] * 7, 1), (10, [float("inf")] + [1.0] * 7, 1), (11, [], 1), (12, [1.0, 0.0], 1), (13, [3.0, 0.0], 1), (None, one, 1), (14, [-0.0, 1.0], 1), (15, [0.0, 1.0], 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], VEC + ", node int, links string")
    got = E.embedding_dedup(docs).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[3] == (3, 1, False) and by[None] == (3, 1, False)
    assert all(by[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11))
    assert by[12] == (1, 12, True) and by[13] == (1, 12, False) and by[15] == (1, 14, False)
    assert E.embedding_dedup(docs.limit(0)).count() == 0


def near_pairs(dim, n, seed=2):
    rng = np.random.default_rng(seed)
    x = E.unit(rng.standard_normal((n, dim)))
    z = rng.standard_normal(x.shape)
    z = E.unit(z - (z * x).sum(1, keepdims=True) * x)
    return x, 0.98 * x + np.sqrt(1 - 0.98**2) * z


@pytest.mark.parametrize("dim", [2, 3, 4, 5, 7, 8, 12, 16, 31, 32, 64, 256])
def test_caps_of_any_dimension_find_pairs_and_stay_small(dim):
    x, y = near_pairs(dim, 300)
    found = []
    for a, b in ((x, y), (y, x)):
        row, direction, _ = E.decode_caps(a, E.depth(E.REACH, dim))
        caps = set(zip(row.tolist(), direction.tolist(), strict=True))
        found.append([(i, d) in caps for i, d in enumerate(E.best_directions(b).tolist())])
        assert len(row) / len(a) < 2000
    assert np.logical_or(*found).mean() > 0.99


@pytest.mark.parametrize("dim", [1, 2, 3, 4, 8])
def test_few_dimensions(spark, dim):
    rows = vectors(4, dim)[:150]
    got = E.embedding_dedup(spark.createDataFrame(rows, VEC)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows)


def test_all_64_bit_ids_and_rows_without(spark):
    rows = vectors(5)[:120]
    wide = [-(1 << 63), (1 << 63) - 1, 1 << 62, 0]
    rows = [(wide[i] if i < 4 else k, v, y) for i, (k, v, y) in enumerate(rows)]
    got = E.embedding_dedup(spark.createDataFrame(rows, VEC)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows)
    some = [(None, v, y) if i % 3 == 0 else (k, v, y) for i, (k, v, y) in enumerate(rows)]
    links = sorted(r.n_links for r in E.embedding_dedup(spark.createDataFrame(some, VEC)).collect())
    assert links == sorted(n for n, _ in brute_links(rows).values())


def test_text_labels(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [1.0, 0.01], "a"), (4, [1.0, 0.0], None)]
    got = E.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4)}
