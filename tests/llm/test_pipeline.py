from pathlib import Path

import pytest

import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard_join import brute as groups
from tidemark.llm.quality import score_quality

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    score = score_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {r.doc_id for r in score.where("predicted = 1").collect()}
    seen = docs
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, seen, str(DATA)).write.parquet(out := f"{tmp_path}/{k}")
        seen = spark.read.parquet(out)
        if name == "near_duplicates":
            found = groups([(d, rows[d]) for d in want], 5, 80)
            want = {d for d in want if found[d][1] == d}
        if name == "decontamination":
            found = leaks([(d, rows[d]) for d in want], items)
            want = {d for d in want if not found[d][4]}
        assert {r.doc_id for r in seen.select("doc_id").collect()} == want
        if k < 4:
            assert seen.columns == docs.columns
        if name in ("quality", "near_duplicates", "decontamination"):
            assert all(r.text == rows[r.doc_id] for r in seen.collect())
        if name == "secrets":
            for r in seen.collect():
                assert "AKIA" not in r.text and r.n_chars == len(r.text)
                assert r.text == rows[r.doc_id] or "[REDACTED]" in r.text
    assert seen.where("not round_trip").count() == 0
    whole = {(r.doc_id, r.ids_sha256) for r in P.run(spark, str(DATA)).collect()}
    assert whole == {(r.doc_id, r.ids_sha256) for r in seen.collect()}


def test_null_rows(spark):
    docs = spark.createDataFrame([(None, "one two three four five six", "en", "s", 5), (3, "one two three four five six", "en", "s", None), (4, None, None, None, None), (5, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars int")
    kept = P.near_duplicates(spark, docs, str(DATA))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 4, 5]
    assert P.decontamination(spark, docs, str(DATA)).count() == 4
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in P.tokens(spark, P.secrets(spark, docs, str(DATA)), str(DATA)).collect()) == [(0, True), (3, True), (4, False), (5, False)]
