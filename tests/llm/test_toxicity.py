import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from boundwell.llm import toxicity as T
from tests.llm import brute

DOC = "doc_id long, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=14))
def test_segments_are_all_maximal_ones(scores):
    """By the definition: the greatest-sum segment, then the same to its left and right."""

    def split(lo, hi):
        best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
        if best[0] <= 0:
            return []
        a, b = best[3], best[4]
        return [*split(lo, a), (a, b, best[0]), *split(b, hi)]

    got = T.maximal_segments([float(s) for s in scores])
    assert sum(s for *_, s in got) == sum(s for *_, s in split(0, len(scores)))
    assert max((s for *_, s in got), default=0) == max((s for *_, s in split(0, len(scores))), default=0)
    assert all(sum(scores[a:b]) == s > 0 for a, b, s in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    bad = ["vile", "rotten", "fiend", "gormx", "gormyz", "gormab"]
    docs, labels = [], []
    for i in range(n):
        words = brute.prose(rng, rng.randrange(5, 150)).split()
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(1 + len(words) // 25):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", ",", "!"])
        docs.append((i, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    got = T.toxicity(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [(truth[r.doc_id], r.score, r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80
    y, s = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    assert auc > 0.97
    assert np.mean([h[0] == h[2] for h in held]) > 0.93


def test_only_training_labels_and_texts_count(spark):
    import zlib

    docs, labels = corpus(2, 300)
    flipped = [(i, 1 - y) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, y) for i, y in labels]
    run = lambda rows, extra: {r.doc_id: r.score for r in T.toxicity(spark.createDataFrame([(*d, extra) for d in docs], DOC + ", lang string"), spark.createDataFrame(rows, "doc_id long, toxic int")).collect()}
    assert run(labels, "en") == run(flipped, "de")


def test_passages_are_found():
    docs, labels = corpus(3)
    table = np.zeros((2, 1 << T.BITS), np.float32)
    for _, _, features, _ in T.tokens([b"vile rotten fiend"]):
        table[:, features[0]] = 5.0
    text = b"calm " * 50 + b"vile rotten calm fiend " + b"calm " * 50
    ((n, found),) = T.segments_of([text], table)
    assert n == 104 and [(a, b) for a, b, _ in found] == [(50, 54)]
    assert T.Model(table, decay=2.0, k=0.1).passages(n, found)[0][:2] == (50, 54)


def test_edge_cases(spark):
    docs, labels = corpus(4, 200)
    rows = [*docs, (1000, None), (1001, ""), (1002, "vile " * 30_000), (1003, "?!"), (1004, "same"), (1004, "same"), (None, "vile vile")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], DOC + ", toxic int, label_id string")
    marks = spark.createDataFrame([*labels, (1, None), (None, 1), (labels[0][0], 1)], "doc_id long, toxic int")
    got = T.toxicity(frame, marks).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score == by[1003].score and by[1000].predicted == 0
    kept = T.drop_toxic(frame, marks)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    assert T.toxicity(frame.limit(0), marks).count() == 0
    none = T.toxicity(frame, marks.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.predicted for r in none)
