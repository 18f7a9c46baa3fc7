from tidemill.llm import simhash

from .helpers import documents, rng


def words(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def bits(a, b):
    x, y = (simhash.set_fingerprint(simhash.shingle_hashes(t.encode(), 5), 4) for t in (a, b))
    return sum((int(p) ^ int(q)).bit_count() for p, q in zip(x, y, strict=True))


def pair(r, shared, own):
    """Two texts with so many five-word shingles in common and of their own."""
    head = words(r, shared + 4)
    return [f"{head} {words(r, own)}" for _ in range(2)]


def test_similarity_is_judged_by_shingles(spark):
    r = rng(31)
    below = next(p for p in (pair(r, 50, 10) for _ in range(100)) if bits(*p) <= 50)
    exact = next(p for p in (pair(r, 40, 5) for _ in range(2000)) if 50 < bits(*p) <= 60)
    assert jaccard(*below) < 0.8 and jaccard(*exact) == 0.8
    got = simhash.keep_first(documents(spark, list(enumerate([*below, *exact])))).collect()
    assert {x.doc_id for x in got} == {0, 1, 2}


def test_groups_match_brute_force(spark):
    r = rng(32)
    texts = []
    for _ in range(6):
        base = words(r, 150).split()
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(w))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = simhash.keep_first(documents(spark, list(enumerate(texts)))).collect()
    assert sorted(x.doc_id for x in got) == sorted(set(label)) and 6 < len(got) < len(texts)


def test_repeated_rows_and_clashing_names(spark):
    r = rng(33)
    one, other = words(r, 60), words(r, 60)
    rows = [(3, one), (3, one), (3, other), (5, f"{one} end"), (None, one), (None, one), (7, None), (8, ""), (8, "")]
    docs = documents(spark, rows).selectExpr("*", "1 AS b_id", "2 AS b0", "3 AS _key_0", "4 AS id", "5 AS stays")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((x.doc_id or 0, x.text or "") for x in got.collect()) == sorted([(3, one), (3, other), (0, one), (0, one), (7, "")])
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_one_family_over_many_pages_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAGE", 40)
    monkeypatch.setattr(simhash, "PAGE_BYTES", 20_000)
    r = rng(34)
    base, texts = words(r, 120).split(), []
    for _ in range(160):
        w = list(base)
        for _ in range(r.randint(1, 9)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(w))
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    kept = []
    real = simhash._unsettled
    monkeypatch.setattr(simhash, "_unsettled", lambda *a: kept.append(real(*a)) or kept[0])
    got = simhash.keep_first(documents(spark, list(enumerate(texts)))).collect()
    assert sorted(x.doc_id for x in got) == sorted(set(label)) and 3 < len(got) < 150
    open_ = kept[0].select("home", "label").collect()
    assert open_ and len({x.label for x in open_ if not x.home}) == 1 < len({x.label for x in open_})
