import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemill.llm import components, decontaminate, simhash, suffix_dedup

from .helpers import covered_bytes, documents, prose, rng


def spans_and_hash(text, mask):
    kept = bytes(np.frombuffer(text, np.uint8)[~mask]) if text else b""
    runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
    return len(text), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("seed", "length", "k", "hot"), [(1, 20, 8, 10**9), (2, 12, 5, 10**9), (3, 20, 8, 2), (4, 9, 9, 3)])
def test_repeats_match_brute_force(spark, seed, length, k, hot):
    r = rng(seed)
    pool = [prose(r, 6, 30) for _ in range(4)] + ["aaaaaaaaaaaaaaaa" * 3, "äöü" * 12]
    texts = ["".join(r.choice(pool) if r.random() < 0.5 else prose(r, 4) for _ in range(r.randint(0, 5))) for _ in range(25)]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "short"), (None, texts[3] + "x"), (903, "same row " * 5), (903, "same row " * 5)]
    got = suffix_dedup.remove_repeats(documents(spark, rows), length, k, hot).collect()
    want = sorted(spans_and_hash(t.encode(), m) for (_, t), m in zip([(i, t or "") for i, t in rows], covered_bytes([(t or "").encode() for _, t in rows], length), strict=True))
    assert sorted((g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == want


def test_kernel_survives_hash_collisions(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TABLE", np.full(256, 3, np.uint64))  # every byte hashes alike
    monkeypatch.setattr(suffix_dedup, "_mix", lambda h: h)
    texts = [b"abcabcabcxyzabcdef", b"zzabcabcabcxyq", b"qqqqqqqqqq"]
    rows = [(h, o, p, lo, hi) for owner, hs, place, los, his in suffix_dedup.text_anchors(texts, 6, 3) for h, o, p, lo, hi in zip(hs.tolist(), owner.tolist(), place.tolist(), los.tolist(), his.tolist(), strict=True)]
    rows.sort()
    h = np.array([r[0] for r in rows], np.uint64)
    group = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]).astype(int)]))
    who, a, b = suffix_dedup.covered([texts[o][p - hi : p + 6 - lo] for _, o, p, lo, hi in rows], group, np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), 6)
    out = [np.zeros(len(t), bool) for t in texts]
    for w, x, y in zip(who, a, b, strict=True):
        out[rows[w][1]][rows[w][2] + x : rows[w][2] + y] = True
    for got, want in zip(out, covered_bytes(texts, 6), strict=True):
        assert not (got & ~want).any()


def test_kernel_holds_bounded_strings(monkeypatch):
    r = np.random.default_rng(3)
    word = lambda n: r.integers(97, 123, n, dtype=np.uint8).tobytes()
    heads, tails = [word(30) for _ in range(60)], [word(34) for _ in range(50)]
    texts = [heads[i] + b"anchor" + tails[j] for i in range(60) for j in range(50)]  # each half is shared, no whole; every string over both halves is open
    group, lo, hi = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.full(len(texts), 30)
    monkeypatch.setattr(suffix_dedup, "STRINGS", 1 << 12, raising=False)
    tracemalloc.start()
    who, a, b = suffix_dedup.covered(texts, group, lo, hi, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    times = Counter((o, t[30 - o : 70 - o]) for t in texts for o in range(31))
    want = {(i, k) for i, t in enumerate(texts) for o in range(31) if times[o, t[30 - o : 70 - o]] > 1 for k in range(30 - o, 70 - o)}
    assert {(i, k) for i, x, y in zip(who.tolist(), a.tolist(), b.tolist(), strict=True) for k in range(30 + x, 30 + y)} == want
    assert peak < 24 << 20


def test_strip_and_leak_test_run_once(spark):
    d = documents(spark, [(1, "some text"), (2, "other text")])
    steps = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    assert steps(suffix_dedup.strip_documents(d)) == 0  # before, a filter moved below it ran it twice
    tests = spark.createDataFrame([(0, "some words of a test that is long enough")], "item_id long, text string")
    assert steps(decontaminate.drop_leaks(d, tests)) == 1


def test_powers_of_a_large_text_are_not_kept():
    suffix_dedup._powers(3 << 20)
    assert all(len(p) <= 1 << 20 for p in suffix_dedup._POW.values())


def test_strip_documents_keeps_columns(spark):
    r = rng(5)
    shared = prose(r, 60)
    d = documents(spark, [(1, prose(r, 30) + shared), (2, shared + prose(r, 30)), (3, shared), (4, None), (5, "alone")])
    got = {x.doc_id: x for x in suffix_dedup.strip_documents(d).collect()}
    assert set(got) == {1, 2, 4, 5} and got[4].text is None and got[5].text == "alone"
    assert all(len(shared) - 10 > len(got[i].text) and got[i].n_chars == len(got[i].text) for i in (1, 2))
    assert suffix_dedup.strip_documents(d).columns == d.columns


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    n = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(sh))


def test_simhash_matches_brute_force(spark):
    r = rng(7)
    base = [prose(r, 300) for _ in range(6)]
    rows = []
    for i in range(60):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "changed"
        rows.append((1000 - i, " ".join(w)))
    rows += [(5, None), (3, ""), (9, " \n"), (None, base[0]), (None, "only here"), (77, "one"), (78, "ONE"), (77, "one"), (80, prose(r, 40_000))]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    fp = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    ids = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    want = sorted(map(repr, ((rows[i][0], f"{fp[i]:016x}", ids[label[i]]) for i in range(len(rows)))))
    assert sorted(map(repr, map(tuple, got))) == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_pages_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAGE", 7)
    monkeypatch.setattr(simhash, "TILE", 4)
    r = rng(8)
    fps = list({r.choice([0, 0xFFFF, 0xFF00FF00]) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(80)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s, s) for s in signed], "id long, w0 long")
    found = components.components(simhash.links(simhash.banded(nodes, 3), 3), nodes.selectExpr("id AS node", "id AS label")).collect()
    up = {s: s for s in signed}
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = up[signed[i]], up[signed[j]]
                up = {k: (min(x, y) if v in (x, y) else v) for k, v in up.items()}
    assert {x.node: x.label for x in found} == up


def test_keep_first_drops_near_copies_only(spark):
    r = rng(9)
    texts = [prose(r, 300) for _ in range(12)]
    near = texts[0].split()
    near[150] = "changed"
    rows = list(enumerate(texts)) + [(50, " ".join(near)), (51, texts[1]), (52, texts[1]), (None, texts[2]), (53, None), (54, "")]
    got = simhash.keep_first(documents(spark, rows)).collect()
    assert sorted(x.doc_id for x in got if x.doc_id is not None) == [*range(12), 53]
    assert sum(x.doc_id is None for x in got) == 1


def test_chain_of_components(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    labels = spark.createDataFrame([(i, i) for i in range(n + 1)] + [(100, 100), (101, 101), (200, 200)], "node long, label long")
    got = {x.node: x.label for x in components.components(edges, labels).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100, 200: 200}
