import corpus_pipeline as P
from tidemark.llm.jaccard_join import linked

A, B, C = ("one two three four five six seven", "red green blue cyan pink gray black", "alpha beta gamma delta epsilon zeta eta")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def rows(spark, pairs):
    return spark.createDataFrame([(d, t, "en", "s", None) for d, t in pairs], SCHEMA)


def test_decontamination_judges_each_row(spark, tmp_path):
    leak = "a b c d e f g h i j"
    spark.createDataFrame([("x", leak)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = rows(spark, [(None, f"so {leak} so"), (None, A), (None, None), (7, leak), (7, B), (8, C)])
    got = [(r.doc_id, r.text) for r in P.decontamination(spark, docs, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(None, A), (None, None), (7, B), (8, C)]))


def test_copies_without_an_id_go(spark):
    docs = rows(spark, [(None, A), (None, A), (None, B), (None, None), (None, None), (3, A), (4, B), (5, C), (6, C)]).repartition(3)
    got = [(r.doc_id, r.text) for r in P.near_duplicates(spark, docs, "").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(None, A), (None, B), (None, None), (None, None), (5, C)]))


def test_different_texts_without_an_id_keep_their_links(spark):
    docs = rows(spark, [(None, A), (None, B), (None, C), (1, A), (2, B), (3, C), (4, "no other text is like this one")])
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in linked(docs).collect())
    assert got == [(0, 0), (0, 0), (0, 0), (1, 0), (2, 0), (3, 0), (4, 4)]
