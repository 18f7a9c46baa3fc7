import hashlib
from collections import defaultdict

import pytest

from tidemill.llm import chat_format, decontaminate, mixing, url_filter, warc
from tidemill.llm.common import fresh_path
from tidemill.llm.queries import RULES, labelled_urls

from .helpers import WORD, documents, prose, rng


def brute_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = dict(zip(names, [5, 2, 1] * len(names), strict=False))
    total, target, open_ = sum(size.values()), {}, set(names)
    while open_:
        left, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * size[s]]
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        for s in over:
            target[s] = 3.0 * size[s]
            open_.discard(s)
    return target


def test_mix_reaches_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 8)
    r = rng(1)
    rows = [(i, prose(r, r.randint(1, 60)), r.choice(["a", "b", "é", "tiny" if i % 50 == 0 else "c", None])) for i in range(600)]
    rows += [(None, "null id here", "a"), (700, None, "a"), (701, "", "empty"), (1, rows[1][1], rows[1][2])]
    got = mixing.plan_mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    want, taken = brute_targets(size), defaultdict(int)
    for g in got:
        assert g.source_size == size[g.source] and g.target == pytest.approx(want[g.source])
        assert g.taken == g.copies * g.size <= 3 * g.size
        assert g.size == 0 or int(g.target / g.source_size) <= g.copies <= int(g.target / g.source_size) + 1
        taken[g.source] += g.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 61
    again = mixing.plan_mix(documents(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.plan_mix(documents(spark, [])).count() == 0


def test_mix_emits_copies(spark):
    rows = [(i, "a b c", "x" if i < 10 else "y") for i in range(40)]
    plan = {g.doc_id: g.copies for g in mixing.plan_mix(documents(spark, rows)).collect()}
    got = defaultdict(int)
    for g in mixing.mix(documents(spark, rows)).collect():
        got[g.doc_id] += 1
    assert dict(got) == {k: v for k, v in plan.items() if v}


def test_urls(spark):
    cases = {
        "http://A.Example.ORG/es/x?q": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "ftp://x.com/fr/1#a/de/": ("x.com", "/fr/1", "com/fr/", "allow"),
        "http://x.com?u=http://y.org/": ("x.com", "", None, None),
        "x.com/de/": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "a://b.com/de/\nline": ("b.com", "/de/\nline", "com/de/", "block"),
    }
    d = spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate(cases)], "page_id long, url string, host string, score double")
    got = url_filter.filter_urls(d, RULES, url_filter.fit(labelled_urls(spark))).collect()
    for g, (u, (host, path, rule, verdict)) in zip(sorted(got), cases.items(), strict=True):
        assert (g.url, g.host, g.path, g.rule) == (u, host, path, rule)
        assert g.verdict == verdict if verdict else g.verdict in ("allow", "block")


def test_url_model_learns(spark):
    model = url_filter.fit(labelled_urls(spark))
    import pandas as pd

    s = model.scores(pd.Series(["m.casino-win.example.com", "free-bets.example.com", "library.example.net", "m.history.example.com"]), pd.Series(["/en/9", "/de/1", "/en/3", "/fr/77"]))
    assert (s[:2] > 0.5).all() and (s[2:] < 0.5).all()
    assert url_filter.fit(labelled_urls(spark).filter("1 = 0")).scores(pd.Series(["a"]), pd.Series(["/"]))[0] == 0.5


def test_warc_round_trip(spark):
    big, trap = "x" * 1500, "WARC/1.1\r\nContent-Length: 9999\r\n\r\n" * 40
    rows = [(1, "http://a.com/", big), (2, "http://b.com/q?x#f", big), (3, None, "é" * 700), (4, "http://c\r\nX: y/", "small"), (5, "u", "small"), (6, "v", None), (7, "w", trap), (None, "n", big), (9, "z", trap), (9, "z", trap), (10, "e", "")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload long")
    path = fresh_path(spark, "warc-test")
    warc.write_warc(d, path)
    whole = warc.assemble(spark, path).cache()
    assert whole.count() == len(rows) and whole.filter("request IS NULL OR metadata IS NULL").count() == 0
    largest = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            largest[h] = max(largest.get(h, i), i)
    many = {h for h in largest if sum(x == h for _, _, x in rows) > 1}
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = largest[h] if h in many and (i is None or i < largest[h]) else None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    assert sorted(map(repr, map(tuple, warc.digests(whole).collect()))) == sorted(map(repr, want))
    bodies = {x.response.payload_sha1: bytes(x.response.payload) for x in whole.collect() if x.response.payload is not None}
    assert all(hashlib.sha1(v).hexdigest() == k for k, v in bodies.items())
    empty = fresh_path(spark, "warc-empty")
    warc.write_warc(d.filter("1 = 0"), empty)
    assert warc.digests(warc.assemble(spark, empty)).count() == 0


def test_perspectives(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK", 2)
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 2, "ann", None), (1, 3, None, "who"), (1, 3, None, "who"), (2, 0, "solo", ""), (None, 1, "x", "null id"), (1, None, "bob", "first")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, name string")
    got = chat_format.rotate_perspectives(d).collect()
    assert len(got) == 6 * 3 + 1 + 1
    for who in ("ann", "bob", "unknown"):
        part = sorted((g for g in got if g.conv_id == 1 and g.perspective == who), key=lambda g: g.char_start)
        assert part[0].turn is None and part[0].char_start == 0
        assert all(a.char_end == b.char_start for a, b in zip(part, part[1:], strict=False))
        assert all(g.char_end - g.char_start == len(g.segment) for g in part)
        assert sum(g.train for g in part) == {"ann": 2, "bob": 2, "unknown": 2}[who]
        assert all((g.name is None) == g.train and (g.role == "assistant") == g.train for g in part)
    assert chat_format.rotate_perspectives(d.filter("1 = 0")).count() == 0


def brute_tiles(doc, test, least):
    """Textbook greedy string tiling on token lists."""
    used_d, used_t, total = set(), set(), 0
    while True:
        best, found = least, []
        for p in range(len(doc)):
            for q in range(len(test)):
                n = 0
                while p + n < len(doc) and q + n < len(test) and doc[p + n] == test[q + n] and p + n not in used_d and q + n not in used_t:
                    n += 1
                if n >= best:
                    found = [(p, q)] if n > best else [*found, (p, q)]
                    best = n
        if not found:
            return total
        for p, q in found:
            if not any(p + i in used_d or q + i in used_t for i in range(best)):
                used_d.update(range(p, p + best))
                used_t.update(range(q, q + best))
                total += best


def test_tiles_match_textbook():
    import numpy as np

    r = rng(4)
    for _ in range(150):
        a, b = [r.choices(range(r.choice([2, 4, 9])), k=r.randint(1, 30)) for _ in range(2)]
        got = decontaminate.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert sum(n for _, _, n in got) == brute_tiles(a, b, 3)
        assert all(a[p : p + n] == b[q : q + n] for p, q, n in got)


def test_leaks(spark):
    r = rng(6)
    tests = [prose(r, 30) for _ in range(8)]
    half = tests[1].split()
    clean = prose(r, 400)
    rows = [(1, f"{clean} {tests[0].upper()}! {clean}"), (2, " ".join(half[15:] + ["x"] + half[:15])), (3, clean), (4, " ".join(half[:10])), (5, None), (6, ""), (None, tests[2]), (7, tests[3] + " " + tests[4]), (7, tests[3] + " " + tests[4]), (8, prose(r, 30_000) + " " + tests[5])]
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(tests)] + [(50, None, 0), (51, "", 0), (52, "one two", 0), (0, tests[0], 0)], "item_id long, text string, doc_id long")
    want = [(1, 0), (2, 1), (None, 2), (7, 3), (7, 4), (7, 3), (7, 4), (8, 5)]
    for size in (1 << 20, 300):
        got = decontaminate.find_leaks(documents(spark, rows), bench, block_bytes=size).collect()
        assert sorted(map(repr, ((g.doc_id, g.item_id) for g in got))) == sorted(map(repr, want))
    assert all(g.covered <= g.item_tokens and g.coverage >= 0.5 for g in got)
    left = decontaminate.drop_leaks(documents(spark, rows), bench)
    assert sorted(x.doc_id for x in left.collect()) == [3, 4, 5, 6]
    assert decontaminate.find_leaks(documents(spark, rows), bench.filter("1 = 0")).count() == 0
