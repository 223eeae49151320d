import hashlib
import os
import random

from boundwell.llm import exact_dedup as E

DOC = "doc_id long, text string"


def test_index_inserts_deletes_and_resizes():
    rng, index, live = random.Random(1), E.CuckooIndex(8), {}
    for _ in range(6000):
        d = hashlib.sha256(str(rng.randrange(1500)).encode()).digest()
        if rng.random() < 0.6:
            assert index.insert(d) == (d not in live)
            live[d] = live.get(d, 0) + 1
        else:
            assert index.delete(d) == (d in live)
            if live.get(d, 0) > 1:
                live[d] -= 1
            else:
                live.pop(d, None)
        assert len(index) == len(live)
    assert index.resizes > 3
    assert all(d in index for d in live)
    assert not any(os.urandom(32) in index for _ in range(1000))


def test_a_fingerprint_hit_is_verified():
    index = E.CuckooIndex(8)
    a = bytes(32)
    b = a[:-1] + b"\x01"  # same fingerprint and buckets, another digest
    assert index.insert(a) and b not in index and index.insert(b) and len(index) == 2


def test_contract_and_edge_cases(spark):
    rows = [(1, "a b"), (2, "ab"), (3, " a\tb\n "), (4, None), (5, ""), (6, " \x0b\x0c\r"), (7, "ab\u00a0"), (8, "AB"), (9, "x" * 100_000), (None, "a  b   "), (10, "q"), (10, "q")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], DOC + ", digest string, n int")
    got = E.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 10)}
    assert by[1].keep_id is None and by[1].group_size == 4 and not by[3].kept  # the longest text has no id
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert by[4].keep_id == 6 and by[5].keep_id == 6 and by[6].kept and by[4].group_size == 3
    assert by[7].kept and by[8].kept and by[9].group_size == 1
    assert sorted(r.kept for r in got if r.doc_id == 10) == [False, True]
    assert by[9].text_sha256 == hashlib.sha256(b"x" * 100_000).hexdigest()
    kept = E.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [6, 7, 8, 9, 10, None]))


def test_empty_table(spark):
    assert E.exact_dedup(spark.createDataFrame([], DOC)).count() == 0
    assert E.drop_copies(spark.createDataFrame([], DOC)).count() == 0


def test_index_tables_take_insertions_and_deletions(spark):
    docs = spark.createDataFrame([(i, f"t{i % 5}") for i in range(20)], DOC)
    index = E.build_index(E.digests(docs))
    assert sorted(r.n for r in index.collect()) == [4] * 5
    more = E.insert_into(index, E.digests(spark.createDataFrame([(100, "t0"), (101, "new")], DOC)))
    assert sorted(r.n for r in more.collect()) == [1, 4, 4, 4, 4, 5]
    gone = E.digests(spark.createDataFrame([(0, "t1")] * 4 + [(0, "t2"), (0, "never")], DOC)).select("digest", "n")
    assert sorted(r.n for r in E.delete_from(more, gone).collect()) == [1, 3, 4, 4, 5]


def test_all_64_bit_ids(spark):
    top = (1 << 63) - 1
    docs = spark.createDataFrame([(top, "a"), (None, "a"), (-top - 1, "b"), (top, "b"), (top, "alone"), (None, "b")], DOC)
    got = E.exact_dedup(docs).collect()
    assert sorted((r.keep_id, r.doc_id, r.kept) for r in got if r.doc_id is not None) == [(-top - 1, -top - 1, True), (-top - 1, top, False), (top, top, True), (top, top, True)]
    assert not any(r.kept for r in got if r.doc_id is None)
    assert sorted((r.doc_id, r.text) for r in E.drop_copies(docs).collect()) == [(-top - 1, "b"), (top, "a"), (top, "alone")]


def test_a_shard_is_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(E, "TASK_ENTRIES", 7)
    docs = spark.createDataFrame([(i, f"t{i % 400}") for i in range(1200)], DOC)
    got = E.exact_dedup(docs).collect()
    assert {(r.doc_id % 400, r.keep_id, r.group_size) for r in got} == {(i, i, 3) for i in range(400)}
    index = E.build_index(E.digests(docs))
    gone = E.digests(docs.where("doc_id < 800")).groupBy("digest").agg(E.F.sum("n").alias("n"))
    assert [r.n for r in E.delete_from(index, gone).collect()] == [1] * 400


def test_texts_move_once_to_drop_copies(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], DOC)
    plan = E.drop_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line and "digest" in line and "named" in line for line in plan.splitlines()) == 1
