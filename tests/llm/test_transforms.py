"""BPE, whitening and fill-in-the-middle against the library, exact integers and plain Python."""

import hashlib
import math
import re
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import bpe, fim, pretokens, queries, whitening

from .helpers import documents, rng

SF = "/root/testdata/sf0.001"
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
SIGNS = ["'", "s", "t", "re", "ll", "ve", "d", "m", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "　", "\xa0", "1", "9", "a", "Z", "!", "?", "é", "漢", "\U0001f600", "\U0001d7d8", "<|endoftext|>", "<|endof"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = rng(3)
    return [None, "", " ", "'s's've x'll 's", "a" * 20_000, "ab" * 10_000, " " * 3_000, *["".join(r.choices(SIGNS, k=r.randint(0, 40))) for _ in range(1_500)]]


def test_bpe_ids_and_text_are_the_librarys(spark, library):
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts())]
    rows += rows[:50]
    got = bpe.round_trip(documents(spark, rows).withColumn("ids", F.lit("clash")), PATH)
    assert {"n_chars", "h", "stats", "score", "ids", "decoded"} <= set(got.columns)
    want = [(k, t, library.encode(t or "", add_special_tokens=False).ids) for k, t in rows]
    want = sorted((repr((k, t)), ids, library.decode(ids, skip_special_tokens=False)) for k, t, ids in want)
    assert sorted((repr((r.doc_id, r.text)), r.ids, r.decoded) for r in got.collect()) == want


def test_every_code_point_is_classed_as_in_the_library(library):
    model, cache = bpe.load(PATH), {}
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    parts = ["".join(f"a{chr(c)}1!{chr(c)}!\n" for c in points[k : k + 4_000]) for k in range(0, len(points), 4_000)]
    for part in parts:
        ids, _ = bpe.encode_texts(model, [part], cache)
        assert ids.tolist() == library.encode(part, add_special_tokens=False).ids


def test_bpe_slices_and_caches_do_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    monkeypatch.setattr(bpe, "INDEX_BYTES", 7)
    model, cache = bpe.load(PATH), {}
    for t in texts()[7:300]:
        ids, counts = bpe.encode_texts(model, [t, "", t], cache)
        assert ids.tolist() == 2 * library.encode(t, add_special_tokens=False).ids and counts.tolist() == [len(ids) // 2, 0, len(ids) // 2]


def test_decode_of_any_ids(spark, library):
    rows = [(1, [0, 5, 200, 50256]), (2, []), (3, None), (4, [172, 255]), (5, [-1, 60_000, 40, None])]
    got = {r.k: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), PATH).collect()}
    assert got == {1: library.decode([0, 5, 200, 50256], skip_special_tokens=False), 2: "", 3: "", 4: library.decode([172, 255], skip_special_tokens=False), 5: library.decode([40], skip_special_tokens=False)}


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        pretokens.PreTokenizer(str(public_tokenizers.path("word_bpe_49k.json")))


def test_bpe_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def exact(vectors):
    """Integer rows, their sums and the covariance as fractions."""
    x = [[max(-whitening.LARGEST, min(whitening.LARGEST, math.floor(Fraction(c) * 1024) + (100_000 if abs(Fraction(c) * 1024) < whitening.LARGEST else 0))) for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    cov = [[Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n) for j in range(len(s))] for i in range(len(s))]
    return x, n, s, cov


@pytest.mark.parametrize("size,scale,offset", [(5, 1.0, 0.0), (12, 0.01, 3.0e4), (4, 1.0e9, 0.0), (3, 8.0e11, 0.0)])
def test_whitening_is_exact(spark, size, scale, offset):
    r = np.random.default_rng(size)
    rows = (r.normal(size=(300, size)) * scale * np.arange(1, size + 1) + offset).tolist()
    rows += rows[:20]
    data = [(k if k % 11 else None, v) for k, v in enumerate(rows)] + [(900, None), (901, []), (902, [None] + [1.0] * (size - 1)), (903, [float("nan")] * size), (904, [float("inf")] * size), (905, [1.0] * (size + 1))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"n": F.lit("clash"), "size": F.lit(1), "p0": F.lit(0)})
    x, n, s, cov = exact(rows)
    model = whitening.fit(df.repartition(3))
    assert (model.n, list(model.sums)) == (n, s)
    assert model.trace == pytest.approx(float(sum(cov[i][i] for i in range(size))), rel=1e-12)
    cov = np.array([[float(c) for c in row] for row in cov])
    assert np.allclose(cov @ model.vectors, model.vectors * model.values, atol=1e-11 * model.values[0])
    k = min(8, size)
    got = whitening.whitened_rows(df.repartition(3)).collect()
    assert len(got) == n * k and {g.component for g in got} == set(range(1, k + 1))
    want = sorted((str(i if i % 11 else None), sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))) for i, v in enumerate(x))
    assert sorted((str(g.vec_id), int(g.deviation)) for g in got if g.component == 1) == want
    assert max(g.identity_error for g in got) < 1e-6
    assert sum({g.component: g.explained for g in got}.values()) == pytest.approx(float(np.sort(np.linalg.eigvalsh(cov))[::-1][:k].sum() / np.trace(cov)))


def test_whitening_of_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened_rows(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened_rows(spark.createDataFrame([(1, None), (2, [None])], schema)).collect() == []
    same = whitening.whitened_rows(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], schema)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(0, None, None, 0.0)] * 4
    flat = whitening.whitened_rows(spark.createDataFrame([(k, [float(k), 2.0, 1e30 if k else -1e30]) for k in range(6)], schema)).collect()
    assert len(flat) == 18 and {r.component for r in flat if r.whitened is not None} == {1}


def test_digit_products_carry(monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "BLOCKS", 3)
    x = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, (200, 3))
    gram = whitening.Gram(3)
    gram.add(x)
    full = [[1, *map(int, r)] for r in x]
    assert {(i, j): v for i, j, v in gram.entries()} == {(i, j): sum(r[i] * r[j] for r in full) for i in range(4) for j in range(i, 4)}


def test_whitening_query(spark):
    rows = [[float(c) for c in r.embedding] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    x, n, s, cov = exact(rows)
    got = queries.op12_whitening(spark, SF).toPandas()
    assert len(got) == 8 * n and got.identity_error.max() <= 1e-4
    values = np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in cov]))[::-1]
    assert np.allclose(got.groupby("component").explained.first(), values[:8] / values.sum(), rtol=1e-9)
    assert sorted(got[got.component == 1].deviation) == sorted(sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x)
    white = got.pivot_table(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(white.T, bias=True) - np.eye(8)).max() < 1e-9


def plain_fim(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if d % 100 < 20:
        return n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fim_equals_plain_version(spark):
    r = rng(1)
    cases = [None, "", "a", "\U0001f600", "<P>x", "x<S", "a\x00b\x00", "\n\n", "<<P>", "\U0001f600a" * 5_000, "a" * 300_000]
    cases += ["".join(r.choices("ab <P>SM\n\x00é漢\U0001f600\U00010000", k=r.randint(0, 30))) for _ in range(500)]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(cases)]
    rows += rows[:30]
    df = documents(spark, rows).withColumns({"form": F.lit("clash"), "units": F.lit(0), "fim_units": F.lit(0)})
    got = fim.transform(df)
    assert {"units", "fim_units", "h", "output"} <= set(got.columns)
    back = fim.digests(got).collect()
    want = [(k, *plain_fim(k, t), t or "") for k, t in rows]
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((k, n, f, p, m, sha(o), sha(t))) for k, n, f, p, m, o, t in want)
    assert sorted(x.output for x in got.select("output").collect()) == sorted(w[5] for w in want)


@pytest.mark.parametrize("grammar,pattern", [(fim.WORDS, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"), (fim.LINES, r"[^\n]*\n|[^\n]+"), (fim.CODE_POINTS, r"(?s).")])
def test_units_are_matches_of_the_grammar(spark, grammar, pattern):
    r = rng(2)
    cases = ["", "\n", "a", *["".join(r.choices("ab \n\t\x0b　\U0001f600", k=r.randint(0, 20))) for _ in range(300)]]
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", fim.units(F.col("t"), grammar).alias("u")).collect()
    assert all(x.u == re.findall(pattern, x.t) for x in got)


def test_units_refuse_classes_that_halves_of_wide_code_points_could_tell_apart():
    with pytest.raises(ValueError, match="ASCII"):
        fim.UnitGrammar(((r"\p{L}", True), (r"\P{L}", False))).boundary()


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert fim.transform(empty).collect() == [] and bpe.round_trip(empty, PATH).collect() == []
