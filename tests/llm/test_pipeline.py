import corpus_pipeline
from cellclock.llm.common import ready, written

from .conftest import ODD


def test_stages_keep_columns(spark, odd, empty, tmp_path):
    from conftest import SF_DIR

    ready(spark)
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_DIR)
            assert out.columns == docs.columns
            docs = written(out, name)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
        assert {"ids", "n_tokens", "decoded"} <= set(last.columns)
        assert last.count() <= len(ODD)


def test_run(spark):
    from conftest import SF_DIR

    before = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, SF_DIR)
    rows = {r.doc_id: r for r in out.collect()}
    assert 0.5 * before.count() < len(rows) < before.count()
    whole = {r.doc_id: r for r in before.collect()}
    assert all(r.lang == whole[i].lang and len(r["ids"]) == 4 * r.n_tokens for i, r in rows.items())
