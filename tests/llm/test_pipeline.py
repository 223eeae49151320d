import hashlib
import random

import pytest

import corpus_pipeline
from boundwell.llm import packing
from boundwell.llm.queries import vocabulary
from tests.llm import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, docs, labels = random.Random(1), [], []
    shared = brute.prose(rng, 90)
    for i in range(400):
        words = brute.prose(rng, rng.randrange(20, 120)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2 + len(words) // 20):
                words[rng.randrange(len(words))] = rng.choice(["vile", "rotten", "fiend"])
        text = " ".join(words)
        docs.append((i, text))
        labels.append((i, int(toxic)))
    base = [docs[k][1] for k in (1, 2, 3)]
    docs += [(1000, base[0]), (1001, base[0].replace(" ", "\n", 1)), (1002, base[1] + " tail"), (1003, base[2] + "\n" + shared), (1004, brute.prose(rng, 60) + "\n" + shared), (1005, None), (1006, "")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs], DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(docs), dict(labels), shared


def test_stages_take_effect(spark, tables, tmp_path):
    folder, texts, toxic, shared = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    left = {r.doc_id for r in steps["toxicity"]}
    wrong = [k for k, y in toxic.items() if (k not in left) != bool(y)]
    assert len(wrong) < 12
    squeezed = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    once = [squeezed(r.text) for r in steps["exact_dedup"]]
    assert len(once) == len(set(once)) == len({squeezed(r.text) for r in steps["toxicity"]})
    before = {r.doc_id: r.text for r in steps["exact_dedup"]}
    groups = brute.near(before, 5)
    assert {r.doc_id for r in steps["near_dedup"]} == {k for k, (_, c) in groups.items() if c == k}
    rest = {r.doc_id: r.text for r in steps["near_dedup"]}
    want = {k: (n - removed, sha) for k, n, removed, _, sha in brute.repeats(list(rest.items()), 200)}
    for r in steps["suffix_dedup"]:
        data = (r.text or "").encode()
        assert len(data) <= want[r.doc_id][0] and r.n_chars == (len(r.text) if r.text is not None else r.n_chars)
        if len(data) == want[r.doc_id][0]:
            assert hashlib.sha256(data).hexdigest() == want[r.doc_id][1]
    assert not any(shared[20:-20] in (r.text or "") for r in steps["suffix_dedup"])
    assert {r.doc_id for r in steps["packing"]} == {r.doc_id for r in steps["suffix_dedup"]} == set(rest)
    assert sum(r.length for r in steps["packing"]) == sum(r.length for r in packing.pieces(spark.read.parquet(str(tmp_path / "suffix_dedup")), vocabulary()).collect())


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables[0]).collect()
    assert rows and len(rows) == len({(r.doc_id, r.piece) for r in rows})
