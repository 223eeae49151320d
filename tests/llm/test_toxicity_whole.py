"""What toxicity must not leave out of a score or of the training."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boundwell.llm import toxicity as T
from tests.llm import brute
from tests.llm.test_toxicity import DOC, corpus


@pytest.fixture
def fitted(monkeypatch):
    """The rows that fit() gets."""
    kept, fit = [], T.fit
    monkeypatch.setattr(T, "fit", lambda table, rows, histogram: kept.extend(rows) or fit(table, rows, histogram))
    return kept


def test_every_segment_is_evidence():
    model = T.Model(np.zeros((2, 1), np.float32), decay=1.0, k=0.01)
    one = np.log(10) + 1.2  # n = 1000: 1.2 above log(K n)
    got = [model.evidence(1000, [(0, 0, one)] * m) for m in (8, 20, 40)]
    assert np.allclose(got, (7.4, 31, 86), atol=0.5)


def test_every_segment_trains(spark, fitted):
    docs, labels = corpus(6)
    rng = random.Random(7)
    long = " ".join(" ".join([*brute.prose(rng, 30).split()[:30], "vile"]) for _ in range(40))
    free = next(i for i in range(5000, 5100) if not spark.range(i, i + 1).select(T.held_out(T.F.col("id"))).first()[0])
    T.train(spark.createDataFrame([*docs, (free, long)], DOC), spark.createDataFrame([*labels, (free, 1)], "doc_id long, toxic int"))
    assert max(len(scores) for _, _, scores in fitted) >= 40


def test_texts_that_share_a_passage_all_train(spark, fitted):
    docs, labels = corpus(8, 300)
    shared = brute.prose(random.Random(9), 80)
    docs = [(i, f"{text} {shared}") for i, text in docs]
    copies = [(10_000 + i, text) for i, text in docs]
    marks = [*labels, *((10_000 + i, y) for i, y in labels)]
    T.train(spark.createDataFrame([*docs, *copies], DOC), spark.createDataFrame(marks, "doc_id long, toxic int"))
    text = dict([*docs, *copies])
    ids = spark.createDataFrame(marks, "doc_id long, toxic int").where(~T.held_out(T.F.col("doc_id"))).collect()
    assert len(fitted) == len({(text[r.doc_id], r.toxic) for r in ids})


def by_definition(scores):
    """Segments all of whose own prefixes and suffixes are positive, and that lie in no larger one."""
    n = len(scores)
    good = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if all(sum(scores[a:k]) > 0 for k in range(a + 1, b + 1)) and all(sum(scores[k:b]) > 0 for k in range(a, b))]
    return sorted((a, b, sum(scores[a:b])) for a, b in good if not any(x <= a and b <= y and (x, y) != (a, b) for x, y in good))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=16))
def test_segments_are_those_of_the_definition(scores):
    assert T.maximal_segments([float(s) for s in scores]) == by_definition(scores)


class Steps(float):
    """A number that counts its comparisons."""

    taken = 0

    def __add__(self, other):
        return Steps(float(self) + other)

    __radd__ = __add__

    def __ge__(self, other):
        Steps.taken += 1
        return float(self) >= float(other)


def test_the_scan_is_linear():
    rng = random.Random(3)
    walks = (lambda n: [1.0, -2.0] * n, lambda n: [2.0, -1.0] * n, lambda n: [rng.choice((-1.0, 1.0)) for _ in range(2 * n)], lambda n: [float(n - i) if i % 2 else -1.5 for i in range(2 * n)])
    for walk in walks:
        taken = []
        for n in (2000, 4000, 8000):
            Steps.taken = 0
            T.maximal_segments([Steps(s) for s in walk(n)])
            taken.append(Steps.taken)
        assert taken[2] <= 6 * 8000 and taken[2] <= 2.3 * taken[1] + 50


def test_calibration_on_simulated_clean_text():
    """Of texts drawn from the null model about as many have a segment of an E-value as the law says, and few score as toxic."""
    rng = np.random.default_rng(5)

    def texts(n, toxic):
        out = []
        for _ in range(n):
            size = int(rng.integers(50, 400))
            s = np.where(rng.random(size) < 0.02, rng.choice([1.5, 2.5, 3.5], size), -0.5)
            if toxic:
                s[rng.integers(0, size, max(3, size // 15))] = 5.0
            out.append((int(toxic), size, s))
        return out

    def segments(rows):
        return [(y, n, np.array([x[2] for x in T.maximal_segments(s.tolist())])) for y, n, s in rows]

    fit_on = [*texts(1500, False), *texts(200, True)]
    histogram = sum(np.bincount(np.clip(np.rint(s * 10) + 70, 0, 140).astype(int), minlength=141) for y, _, s in fit_on if not y)
    model = T.fit(np.zeros((3, 1), np.float32), segments(fit_on), histogram)
    fresh = segments(texts(2000, False))
    for e in (0.3, 0.1):
        share = np.mean([any(len(model.passages(n, [(0, 0, v)], e)) for v in s) for _, n, s in fresh])
        assert share < 3 * e
    assert np.mean([model.probability(model.evidence(n, [(0, 0, v) for v in s])) >= 0.5 for _, n, s in fresh]) < 0.01
    found = segments(texts(500, True))
    assert np.mean([model.probability(model.evidence(n, [(0, 0, v) for v in s])) >= 0.5 for _, n, s in found]) > 0.95


def test_unseen_words_take_no_score():
    table = T.score_table(np.array([5 << T.CHECK | 77, 5 << T.CHECK | 78]), np.array([4.0, 5.0]), np.array([6.0, 9.0]))
    slots = [np.array([5, 5, 6, -1])] + [np.full(4, -1)] * len(T.PREFIXES)
    checks = [np.array([78, 77, 78, -1])] + [np.full(4, -1)] * len(T.PREFIXES)
    assert T.token_scores(slots + checks, table).tolist() == [4.5, -0.5, -0.5, -0.5]
