from collections import Counter

import __spark_entry__
import corpus_pipeline

from .helpers import documents, rng
from .test_pipeline import sentence


def test_mixed_corpus_has_planned_copies(spark, tmp_path):
    r = rng(21)
    rows = [(i, sentence(r, 120), "a" if i < 6 else "b") for i in range(40)]
    documents(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, sentence(r, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plan = {x.doc_id: x.copies for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    got = __spark_entry__.queries()["mixed_corpus"](spark, str(tmp_path))
    assert got.columns == [*corpus_pipeline.COLUMNS, "copy"]
    out = got.collect()
    assert Counter(x.doc_id for x in out) == {k: n for k, n in plan.items() if n}
    assert {0, 3} <= set(plan.values())
    assert all(x.text == rows[x.doc_id][1] for x in out)
