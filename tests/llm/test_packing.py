import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from boundwell.llm import packing as K
from tests.llm import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12), st.just(30))
def test_plan_uses_every_piece_once(counts, capacity):
    used = {}
    for lengths, times in K.plan(counts, capacity):
        assert times > 0 and sum(lengths) <= capacity
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts


def test_smallest_is_replaced_by_a_tighter_pair():
    # Greedy takes 6 and 3; 2 + 2 fill the gap of 4 that 3 leaves.
    assert K.plan({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)


def test_plan_is_near_the_lower_bound():
    rng = np.random.default_rng(0)
    counts = {int(k): int(v) for k, v in zip(*np.unique(np.minimum(rng.lognormal(5.5, 1, 30_000).astype(int) + 1, 2048), return_counts=True), strict=True)}
    bins = sum(t for _, t in K.plan(counts, 2048))
    assert bins <= 1.002 * sum(k * v for k, v in counts.items()) / 2048 + 1


def test_pieces():
    assert K.piece_bounds(2048, 2048) == [(0, 2048)]
    assert K.piece_bounds(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]
    assert K.piece_bounds(4096, 2048) == [(0, 2048), (2048, 2048)]
    assert K.piece_bounds(1, 2048) == [(0, 1)]


def test_contract_and_edge_cases(spark):
    rng = random.Random(1)
    rows = [(i, brute.prose(rng, rng.randrange(0, 200))) for i in range(120)] + [(500, None), (501, ""), (502, "word " * 20_000), (503, "same"), (503, "same"), (None, "x")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length int, part int")
    library = Tokenizer.from_file(PATH)
    got = K.pack(docs, PATH).collect()
    want = {}
    for k, t in rows:
        want.setdefault(k, [*library.encode(t or "", add_special_tokens=False).ids, 0])
    bins, own = {}, {}
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        own.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for k, ids in want.items():
        copies = 2 if k == 503 else 1
        assert sorted(own[k]) == sorted([(p, a, n) for p, (a, n) in enumerate(K.piece_bounds(len(ids), 2048))] * copies)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1
    assert K.pack(docs.limit(0), PATH).count() == 0
    whole = {r.sequence_id: r for r in K.sequences(docs, PATH).collect()}
    assert sum(len(r.ids) for r in whole.values()) == sum(r.length for r in got)
    assert all(r.ids[p.offset] == want[p.doc_id][K.piece_bounds(len(want[p.doc_id]), 2048)[p.piece][0]] for r in whole.values() for p in r.parts)
