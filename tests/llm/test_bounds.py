"""Hot groups, repeated rows, clashing ids, empty tables, and plain versions of what SQL cannot say."""

import gzip
import math
import os

import numpy as np
import pytest
import pandas as pd

from tidemill.llm import byte_cnn, decontaminate, mixing, simhash, suffix_dedup, url_filter, warc
from tidemill.llm.common import fresh_path

from .helpers import documents, prose, rng


def test_unlike_texts_with_one_id_stay(spark):
    r = rng(50)
    a, b, c = (prose(r, 200) for _ in range(3))
    rows = [(1, a), (1, b), (2, c), (2, c), (3, a + " tail"), (None, a), (None, a), (4, None), (5, "")]
    got = simhash.keep_first(documents(spark, rows)).collect()
    assert sorted((x.doc_id, x.text) for x in got if x.doc_id is not None and x.text) == sorted([(1, a), (1, b), (2, c)])
    assert sum(x.doc_id is None for x in got) == 2 and [x.doc_id for x in got if x.doc_id in (4, 5)] == [4]


def test_empty_tables(spark):
    none = documents(spark, [])
    tests = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert simhash.keep_first(none).count() == suffix_dedup.strip_documents(none).count() == suffix_dedup.remove_repeats(none).count() == 0
    assert decontaminate.find_leaks(none, tests).count() == decontaminate.drop_leaks(none, tests).count() == mixing.mix(none).count() == 0


def test_repetitive_texts_take_bounded_work(spark):
    bench = spark.createDataFrame([(1, "a " * 5000), (2, "b c " * 2000)], "item_id long, text string")
    rows = [(1, "a " * 1_000_000), (2, "c b " * 100_000), (3, "a " * 2000), (4, "clean " * 10)]
    got = {(x.doc_id, x.item_id): (x.covered, x.n_tiles) for x in decontaminate.find_leaks(documents(spark, rows), bench).collect()}
    assert got == {(1, 1): (5000, 1), (2, 2): (3999 + 0, 1)} or got == {(1, 1): (5000, 1), (2, 2): (4000, 1)}


def test_equal_hashes_of_unlike_tokens_do_not_count(monkeypatch):
    monkeypatch.setattr(decontaminate, "_hashes", lambda buf, start, end: np.full(len(start), 5, np.uint64))
    block = decontaminate.make_block([0], [b"one two three four five six"])
    texts = [b"uno dos tres cuatro cinco seis", b"zero one two three four five six seven"]
    assert list(decontaminate.match_texts(texts, block, 5, 0.5)) == [(1, 0, 6, 1)]


def test_repeated_rows_are_spread_over_nodes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 8)
    rows = [(1, "a b c", "x")] * 300 + [(None, "a b c", "x")] * 300 + [(i, "a b c d", "y") for i in range(100)]
    got = mixing.plan_mix(documents(spark, rows)).collect()
    assert len(got) == 700
    for s in ("x", "y"):
        mine = [g for g in got if g.source == s]
        assert abs(sum(g.taken for g in mine) - mine[0].target) <= 5
    assert len({g.copies for g in got if g.source == "x" and g.doc_id == 1}) == 2
    assert sorted(map(repr, mixing.plan_mix(documents(spark, rows[::-1])).collect())) == sorted(map(repr, got))


def test_one_long_document_does_not_spoil_a_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 8)
    rows = [(0, "w " * 5_000, "x"), (1, "w " * 3_000, "y")] + [(i, "w " * (3 + i % 40), "xyz"[i % 3]) for i in range(2, 700)]
    for seed in range(3):
        got = mixing.plan_mix(documents(spark, rows), seed=seed).collect()
        assert len(got) == 700
        for s in "xyz":
            mine = [g for g in got if g.source == s]
            assert abs(sum(g.taken for g in mine) - mine[0].target) <= 5 and all(g.taken <= 3 * g.size for g in mine)


def test_picks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 7)
    rows = [(None, "w w w", "x")] * 2_000 + [(5, "w " * 900, "x")] + [(None, "v v v", "y")] * 1_500
    plan = mixing.plan_mix(documents(spark, rows)).toPandas()
    assert len(plan) == len(rows)
    for s in "xy":
        assert abs(plan[plan.source == s].taken.sum() - plan[plan.source == s].target.iloc[0]) <= 3
    got = mixing.mix(documents(spark, rows)).groupBy("source", "copy").count().collect()
    want = {(s, k): int((plan[plan.source == s].copies > k).sum()) for s in "xy" for k in range(3)}
    assert {(r.source, r.copy): r["count"] for r in got} == {k: v for k, v in want.items() if v}


def test_large_pages_fill_small_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 6000)
    monkeypatch.setattr(warc, "FILE_CAPTURES", 3)
    rows = [(i, f"http://x/{i}", f"{i}" * 500) for i in range(20)] + [(100, "http://big/a", "y" * 50_000), (101, "http://big/b", "y" * 50_000), (102, None, None)]
    path = fresh_path(spark, "warc-sizes")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), path)
    files = [gzip.open(f"{path}/{f}").read() for f in os.listdir(path) if f.startswith("part")]
    assert max(f.count(b"WARC-Type: metadata") for f in files) <= 3
    assert sum(f.count(b"WARC-Refers-To-Target-URI: http://big/b") for f in files) == 1
    got = {x.page_id: x for x in warc.digests(warc.assemble(spark, path)).collect()}
    assert len(got) == 23 and got[100].record_type == "revisit" and got[100].refers_to == 101 and got[102].payload_bytes == 0


@pytest.mark.parametrize("ids", [[None] * 40, [7] * 40, [None if k % 2 else k // 4 for k in range(40)]])
def test_captures_of_all_sizes_with_null_and_repeated_ids(spark, ids):
    sizes = [(k % 2) * 100_000 + 2_000 + 50 * k for k in range(40)]
    rows = [(i, f"http://x/{k}", chr(97 + k % 26) * n) for k, (i, n) in enumerate(zip(ids, sizes, strict=True))]
    path = fresh_path(spark, "warc-ids")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), path)
    whole = warc.assemble(spark, path).cache()
    assert sorted((r.metadata.fields.get("pageId"), r.url, r.response.payload_bytes) if r.metadata.fields.get("pageId") else ("", r.url, r.response.payload_bytes) for r in whole.collect()) == sorted(("" if i is None else str(i), u, len(h)) for i, u, h in rows)
    assert whole.select("response.record_id").distinct().count() == 40


def test_url_scores_match_plain_version():
    r = np.random.default_rng(1)
    model = url_filter.UrlModel(r.normal(size=1 << url_filter.BITS), 0.25)
    urls = [("a.example.org", "/en/1"), ("", ""), ("é.com", "/x"), ("ab", "/")]
    got = model.scores(pd.Series([u[0] for u in urls]), pd.Series([u[1] for u in urls]))
    for (host, path), score in zip(urls, got, strict=True):
        w = []
        for part, seed in ((host, 17), (path, 91)):
            data = b"^" + part.encode() + b"$"
            for n in url_filter.GRAMS:
                for i in range(len(data) - n + 1):
                    code = seed * 1_000_003 + n
                    for byte in data[i : i + n]:
                        code = (code * 0x100000001B3 % (1 << 64)) ^ byte
                    code ^= code >> 29
                    w.append(model.weights[(code * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - url_filter.BITS)])
        assert math.isclose(score, 1 / (1 + math.exp(-(sum(w) / math.sqrt(max(len(w), 1)) + 0.25))), rel_tol=1e-9)


def test_network_matches_plain_version():
    rnd = np.random.default_rng(2)
    f, width = byte_cnn.FILTERS, byte_cnn.WIDTH
    m = byte_cnn.Model(rnd.normal(0, 0.3, (byte_cnn.CHANNELS.shape[1] * width, f)).astype(np.float32), rnd.normal(0, 0.1, f).astype(np.float32), rnd.normal(size=2 * f), 0.1)
    r = rng(51)
    texts = [b"", b"short", prose(r, 30).encode(), prose(r, 400).encode(), "é# ".encode() * 300]
    got = byte_cnn.score_texts(texts, m)
    for t, score in zip(texts, got, strict=True):
        blocks = (len(t) + width) // byte_cnn.BLOCK + 1
        data = bytes(width) + t + bytes(blocks * byte_cnn.BLOCK - len(t))
        top = []
        for b in range(blocks):
            y = [byte_cnn.CHANNELS[list(data[i : i + width])].T.ravel() @ m.filters + m.offsets for i in range(b * byte_cnn.BLOCK, (b + 1) * byte_cnn.BLOCK, byte_cnn.STRIDE)]
            top.append(np.maximum(np.max(y, 0), 0))
        chunks = [np.maximum(top[b], top[min(b + 1, blocks - 1)]) for b in range(blocks)]
        logit = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)]) @ m.out + m.bias
        assert math.isclose(score, 1 / (1 + math.exp(-logit)), rel_tol=1e-4)
    assert np.allclose(got, [byte_cnn.score_texts([t], m)[0] for t in texts], rtol=1e-5)  # neighbours change nothing
