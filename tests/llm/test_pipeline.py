import corpus_pipeline
from tidemill.llm import mixing

from .helpers import covered_bytes, documents, prose, rng
from .test_text_rules import expected


def sentence(r, n):
    """Prose with function words, which the quality rules keep."""
    return " ".join(f"the {w} of" for w in prose(r, n, 300).split())


def test_stages_one_by_one(spark, tmp_path):
    r = rng(11)
    shared, leak = sentence(r, 60), sentence(r, 30)
    clean = [sentence(r, 120) for _ in range(20)]
    near = clean[0].split()
    near[100] = "changed"
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(clean)]
    rows += [(100, " ".join(near), "s1"), (101, clean[1], "s2"), (102, f"{sentence(r, 80)} {shared} {sentence(r, 80)}", "s1"), (103, f"{sentence(r, 70)} {shared} {sentence(r, 90)}", "s2")]
    rows += [(104, f"{sentence(r, 50)} {leak} {sentence(r, 50)}", "s3"), (105, "%%% ### $$$ " * 40, "s0"), (106, "same words again " * 60, "s0"), (107, None, "s0"), (108, "", None)]
    documents(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, leak), (1, sentence(r, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = {"in": spark.read.parquet(str(tmp_path / "documents.parquet"))}
    names = ["quality", "near", "repeats", "leaks", "mix"]
    for name, (_, stage), before in zip(names, corpus_pipeline.STAGES, ["in", *names], strict=False):
        path = str(tmp_path / name)
        stage(spark, at[before], str(tmp_path)).write.parquet(path)
        at[name] = spark.read.parquet(path)
        assert name == "mix" or at[name].columns == at["in"].columns
    ids = {k: {x.doc_id for x in v.collect()} for k, v in at.items()}
    texts = {k: {x.doc_id: x.text for x in v.collect()} for k, v in at.items() if k != "mix"}
    # Quality: exactly the documents that break a rule go.
    assert ids["quality"] == {*range(20), 100, 101, 102, 103, 104}
    assert all(expected(texts["in"][i])[0] >= 20 for i in ids["quality"])
    # Near duplicates: the copy with the smallest id stays.
    assert ids["near"] == ids["quality"] - {100, 101}
    # Repeats: the texts are what is left of the input of this stage.
    order = sorted(ids["near"])
    for i, m in zip(order, covered_bytes([texts["near"][i].encode() for i in order], 200), strict=True):
        data = texts["near"][i].encode()
        left = bytes(c for c, gone in zip(data, m, strict=True) if not gone).decode("utf-8", "ignore")
        assert texts["repeats"][i] == left
    assert shared not in texts["repeats"][102] and shared not in texts["repeats"][103]
    # Leaks: the document with the benchmark passage goes, no other.
    assert ids["leaks"] == ids["repeats"] - {104}
    plan = mixing.plan_mix(at["leaks"]).collect()
    assert sorted(map(repr, at["mix"].collect())) == sorted(map(repr, plan))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, plan))
