"""The pipeline's stages take effect one after the other, and its registration."""

import corpus_pipeline
from ledgerline.llm.common import table


def test_stages_follow_each_other_and_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "rules", "dedup", "mixture", "packing"]
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(now) <= ids and now
        if name == "quality":
            bad = [i for i in ids - set(now) if labels.get(i) == 1]
            assert len(bad) <= 0.05 * len(labels)
        if name != "mixture":
            assert len(now) == len(set(now))
        else:
            assert max(now.count(i) for i in set(now)) <= 3
        ids = set(now)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.filter("start = 0").count() == docs.count()


def test_stages_take_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, odd_docs, sf_dir).count() <= 4 * odd_docs.count() + 200
        assert step(spark, no_docs, sf_dir).count() == 0


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
