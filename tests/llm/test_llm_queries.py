"""Registered queries against their SQL, and the pipeline against its stages by brute force."""


import pytest
from compare import differences, duck
from test_llm_methods import brute_components, brute_windows

import corpus_pipeline
from synapta.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, duck(SF), QUERIES[name], ORACLES[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        seen[name], docs = out, out
    names = [n for n, _ in corpus_pipeline.STAGES]
    text = lambda n: {r.doc_id: r.text for r in seen[n].select("doc_id", "text").collect()}
    for n in names[:-1]:
        assert seen[n].columns == seen["documents"].columns
    kept, deduped, stripped, clean = map(text, names[:-1])
    assert set(kept) <= set(text("documents")) and 0 < len(kept)
    comp = brute_components(kept)
    assert set(deduped) == {d for d, (_, root) in comp.items() if d == root}
    want = brute_windows({d: (t or "").split() for d, t in deduped.items()})
    assert stripped == {d: deduped[d] if len(w) == len((deduped[d] or "").split()) else " ".join(w) for d, w in want.items()}
    assert set(clean) < set(stripped) or set(clean) == set(stripped)
    pieces = seen[names[-1]].collect()
    assert {r.doc_id for r in pieces} == set(clean)
    one = {}
    for r in pieces:
        one.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert all(sum(len(b) for _, b in p) == 4 * max(r.doc_tokens for r in pieces if r.doc_id == d) for d, p in list(one.items())[:50])
