from tidemark.llm.secret_scan import redact, scan_secrets

SHORT, LONG = "1beb58b8af68854f0e01", "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"
TEXTS = [
    (1, f'é password={SHORT} and then token = "{LONG}" of'),
    (2, f"é password={SHORT} end, see commit {LONG} now"),
    (3, f'token = "{LONG}" of it and token = "{SHORT}" of é'),
]


def test_nested_values_are_masked_whole_or_kept_whole(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    found = scan_secrets(docs).collect()
    assert all(len([r for r in found if r.doc_id == d]) == 2 for d, _ in TEXTS)
    assert [r.is_secret for r in sorted(found, key=lambda r: (r.doc_id, r.start)) if r.doc_id < 3] == [True, True, True, False]
    want = {}
    for d, text in TEXTS:
        for r in sorted((r for r in found if r.doc_id == d and r.is_secret), key=lambda r: -r.start):
            text = text[: r.start] + "[REDACTED]" + text[r.start + r.length :]
        want[d] = text
    assert {r.doc_id: r.text for r in redact(docs).collect()} == want
