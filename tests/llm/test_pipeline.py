"""The pipeline's stages one by one, and as a whole."""

from __future__ import annotations

import corpus_pipeline as C
import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int"


def test_stages_on_odd_rows(spark, small):
    passage = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    line = "this very line stands in many documents"
    words = " ".join(f"word{k}" for k in range(80))
    rows = [(1, None), (2, "123"), (3, f"{line}\nalpha beta"), (4, f"{line}\ngamma"), (5, f"{line}\ndelta"), (6, words), (7, words.replace("word40", "other")), (8, words), (9, f"before it {passage} after it"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], COLUMNS).select(*C.COLUMNS)
    kept = []
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == C.COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(kept[0]) == {None, 3, 4, 5, 6, 7, 8, 9}
    assert (kept[1][3], kept[1][4], kept[1][5]) == ("alpha beta", "gamma", f"{line}\ndelta")
    assert set(kept[2]) == {None, 3, 4, 5, 6, 9} and set(kept[3]) == {None, 3, 4, 5, 6}
    assert C.STAGES[-1][1](spark, docs, small).count() == 5


def test_stages_on_no_rows(spark, small):
    docs = spark.createDataFrame([], COLUMNS).select(*C.COLUMNS)
    for _, stage in C.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_run_keeps_clean_documents(spark, small):
    out = C.run(spark, small)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    table = spark.read.parquet(f"{small}/documents.parquet")
    assert len(ids) > 0.6 * table.count()


@pytest.mark.parametrize("k", range(4))
def test_stages_return_the_columns(spark, small, k):
    assert C.STAGES[k][1](spark, spark.read.parquet(f"{small}/documents.parquet"), small).columns == C.COLUMNS
