"""The quality rules of the pipeline run no Python on executors."""

from tidemark.llm import quality


def test_labelled_rows_are_found_without_python(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")
    labels = spark.range(0, 20_000, 7).selectExpr("id AS doc_id", "1 AS quality")
    found = quality.perhaps_labelled(docs, quality.usable_labels(labels))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().toString()
    ids = {r.doc_id for r in found.collect()}
    assert ids >= set(range(0, 20_000, 7)) and len(ids) < 5_000
    assert found.columns == docs.columns
