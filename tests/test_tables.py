"""Queries whose batches come from the table."""

from quillspark.plans import registry


def _written(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_hundredth(spark, tmp_path):
    sf = _written(spark, tmp_path, [(i, f"alpha w{chr(97 + i % 26)}{chr(97 + i // 26)}", "s") for i in range(201)])
    q = registry.queries()
    got = lambda name, *c: sorted(tuple(r[x] for x in c) for r in q[name](spark, sf).collect())
    assert got("candidates_and_table", "query_id", "doc_id") == got("search_and_table_topk", "query_id", "doc_id") == [(0, 0), (100, 100), (200, 200)]
    assert len(got("candidates_or_table", "query_id", "doc_id")) == 3 * 201
    assert [x for x in got("search_or_table_topk", "query_id", "rank", "doc_id") if x[1] == 1] == [(0, 1, 0), (100, 1, 100), (200, 1, 200)]
    assert {x[0] for x in got("suggest_table_topk", "query_id")} == {0, 100, 200}


def test_hamming_classes(spark, tmp_path):
    sf = _written(spark, tmp_path, [(5, "one text of copies", "s"), (3, "one text of copies", "s"), (9, "one text of copies", "s"), (4, "quite another thing altogether", "s"), (7, "!!!", "s")])
    q = registry.queries()
    assert q["hamming_pairs"](spark, sf).count() == 0
    got = sorted(tuple(r[c] for c in ("doc_id", "representative", "links")) for r in q["hamming_classes"](spark, sf).collect())
    assert got == [(3, 3, 0), (4, 4, 0), (5, 3, 0), (7, None, 0), (9, 3, 0)]
