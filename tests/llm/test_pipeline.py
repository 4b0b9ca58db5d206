import hashlib
import random

import pytest
from test_llm import brute_bytes, brute_near

from aerolith.llm import decontam, quality
from aerolith.llm.common import staged, table

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    now = staged(pipeline.STAGES[0][1](spark, docs, sf), "t")
    assert {r.doc_id for r in now.collect()} == kept and now.columns == columns

    near = brute_near([(r.doc_id, r.text) for r in now.collect()])
    now = staged(pipeline.STAGES[1][1](spark, now, sf), "t")
    assert {r.doc_id for r in now.collect()} == {i for i, (_, top) in near.items() if i == top} and now.columns == columns

    before = [(r.doc_id, r.text) for r in now.collect()]
    want = brute_bytes(before, kept=True)
    now = staged(pipeline.STAGES[2][1](spark, now, sf), "t")
    rows = now.collect()
    assert {r.doc_id for r in rows} == set(want) and now.columns == columns
    assert {r.doc_id: r.text for r in rows} == {i: b.decode("utf-8", "ignore") for i, b in want.items()}
    assert all(r.n_chars == len(r.text) for r in rows)

    items = [decontam.plain(r.text) for r in table(spark, sf, "benchmark").collect()]
    held = {r.doc_id for r in rows if any(i in decontam.plain(r.text) for i in items)}
    now = staged(pipeline.STAGES[3][1](spark, now, sf), "t")
    left = {r.doc_id: r.text for r in now.collect()}
    assert not set(left) & held and now.columns == columns

    out = {r.doc_id: r for r in pipeline.STAGES[4][1](spark, now, sf).collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()} == {i: r.decoded_sha256 for i, r in out.items()}
    assert {r.doc_id: r.ids_sha256 for r in pipeline.run(spark, sf).collect()} == {i: r.ids_sha256 for i, r in out.items()}


CLASH = ["z", "spans", "n_bytes", "n_removed", "__measured", "measured", "__kept", "node", "whole", "__node", "others", "__text", "key", "n"]


def test_stages_with_odd_rows_and_names(spark, sf):
    """Nulls, repeated rows, shared ids, a long text and clashing names; then no rows at all."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["the", "and", "of", "to", "is", "in", "house", "river", "walks"]) + ("" if rng.random() < 0.6 else str(rng.randrange(10**6))) for _ in range(n)) + "."
    a, b = text(120), text(90)
    rows = [(1, a), (1, a), (1, b), (None, text(80)), (None, text(80)), (4, None), (5, ""), (6, text(30_000)), (7, f"{a} and more")]
    names = ["doc_id", "text", "n_chars", *CLASH]
    docs = spark.createDataFrame([(i, t, len(t or ""), *("v" + c for c in CLASH)) for i, t in rows], "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH))
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.count()
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = staged(stage(spark, docs, sf), "t")
        assert docs.columns == names and 0 < docs.count() <= before
        assert all(r[c] == "v" + c for r in docs.collect() for c in CLASH), name
    assert docs.where("doc_id = 1").count() == 2 and docs.where("doc_id IS NULL").count() == 2 and docs.where("doc_id = 7").isEmpty()
    assert pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
