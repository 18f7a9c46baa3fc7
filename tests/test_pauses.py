"""Pauses, cool-downs and adaptive thresholds: by hand, against plain loops, and the streams against the tables."""

import random
from datetime import datetime, timezone

import pytest

from tidemill.operators import pauses as P
from tidemill.streaming import pauses as SP

START = 1_700_000_000 // 600 * 600


def trade_rows(seed, n=400, keys=("a", "b", None), gap=5_000, win=0.35):
    r = random.Random(seed)
    at, rows = START, []
    for k in range(n):
        at += r.randint(0, gap) if r.random() > 0.01 else 9 * P.DAY
        rows.append((keys[k % len(keys)], at, k, r.choice(["LIVE", "LIVE", "PAPER", ""]), r.choice([None, 0.0]) if r.random() < 0.05 else 1.0 if r.random() < win else -1.0))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, at long, id long, mode string, pnl double")


def plain_pauses(rows, rules):
    """The polling loop itself, poll by poll, over all trades seen so far."""
    out = []
    for key in {r[0] for r in rows}:
        mine = sorted((at, i, mode, pnl) for k, at, i, mode, pnl in rows if k == key and mode in ("LIVE", "PAPER"))
        if not mine:
            continue
        since, poll = None, -(-mine[0][0] // rules.every) * rules.every
        while poll <= mine[-1][0] + rules.hard:
            seen = [t for t in mine if t[0] <= poll]
            live = [(at, (pnl or 0) > 0) for at, _, mode, pnl in seen if mode == "LIVE"][-rules.keep :]
            paper = [(pnl or 0) > 0 for _, _, mode, pnl in seen if mode == "PAPER"][-rules.streak :]
            recent = [w for at, w in live if at >= poll - rules.window]
            five = recent[-rules.streak :]
            event = reason = None
            was = since
            if since is not None:
                gone = poll - since
                if len(recent) < rules.streak:
                    reason = "stale"
                elif gone >= rules.settle and sum(five) >= rules.live_wins:
                    reason = "live_wins"
                elif gone >= rules.settle and len(paper) >= rules.streak and sum(paper) >= rules.paper_wins:
                    reason = "paper_wins"
                elif gone >= rules.soft and sum(paper) >= rules.soft_wins:
                    reason = "time"
                elif gone >= rules.hard:
                    reason = "hard"
                if reason:
                    event, since = "resume", None
            elif len(recent) >= rules.streak and not any(five):
                event, reason, since = "pause", "losses", poll
            if event:
                out.append((key, poll, event, reason, None if was is None else poll - was))
            poll += rules.every
    return sorted(out, key=repr)


RULES = [P.PauseRules(), P.PauseRules(soft_wins=2), P.PauseRules(every=1_800, soft_wins=6, window=P.DAY)]


@pytest.mark.parametrize("rules", RULES)
def test_loss_pauses_are_those_of_the_loop(spark, rules):
    rows = trade_rows(1) + trade_rows(2, 40, ("few",)) + [("none", None, 1, "LIVE", 1.0), ("other", START, 1, "", -1.0)]
    got = P.loss_pauses(frame(spark, rows), rules=rules)
    want = plain_pauses([r for r in rows if r[1] is not None], rules)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert "losses" in {w[3] for w in want}
    spans = P.pause_spans(got).collect()
    assert len(spans) == sum(w[2] == "pause" for w in want) and all(s.resumed_at is None or s.resumed_at > s.paused_at for s in spans)


def test_every_way_to_resume_occurs():
    reasons = {w[3] for seed in range(4) for rules in RULES for w in plain_pauses(trade_rows(seed), rules)}
    assert reasons == {"losses", "stale", "live_wins", "paper_wins", "time", "hard"}


def test_rules_that_no_stretch_can_follow_are_refused():
    with pytest.raises(ValueError, match="multiple"):
        P.PauseRules(every=700)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert P.loss_pauses(none).collect() == [] and P.value_pauses(none).collect() == []
    assert P.cooled_alerts(none, ["symbol"], "at", 5).collect() == []
    d = spark.createDataFrame([], "symbol string, at long, id long, confidence double")
    assert P.adaptive_confidence(d, none).collect() == []


def test_value_pauses_are_those_of_the_loop(spark):
    rows = [r for r in trade_rows(5, 300, ("a", "b"), gap=4_000, win=0.3) if r[4] is not None]
    got = sorted((r.symbol, r.at, r.event, r.n, round(r["mean"], 9) if r.n else None) for r in P.value_pauses(frame(spark, rows), every=1_800, keep=30, least=10, limit=-0.4).collect())
    want = []
    for key in ("a", "b"):
        live = sorted((at, i, pnl) for k, at, i, mode, pnl in rows if k == key and mode == "LIVE")
        poll, stopped = -(-live[0][0] // 1_800) * 1_800, False
        while poll <= live[-1][0] + 7 * P.DAY:
            x = [pnl for at, _, pnl in [t for t in live if t[0] <= poll][-30:] if at > poll - 7 * P.DAY]
            now = len(x) >= 10 and sum(x) / len(x) <= -0.4
            if now != stopped:
                want.append((key, poll, "pause" if now else "resume", len(x), round(sum(x) / len(x), 9) if x else None))
            stopped, poll = now, poll + 1_800
    assert got == sorted(want) and {w[2] for w in want} == {"pause", "resume"}


def alert_rows(seed=3, n=300):
    r = random.Random(seed)
    at, rows = START, []
    for k in range(n):
        at += r.choice([0, 1, 60, 300, 900, 4_000])
        rows.append(("xy"[k % 2], at))
    return rows


def plain_alerts(rows, cooldown):
    out, last = [], {}
    for key, at in sorted(rows, key=lambda x: x[1]):
        if key not in last or at - last[key] >= cooldown:
            last[key] = at
            out.append((key, at))
    return sorted(out)


@pytest.mark.parametrize("cooldown", [1, 900, 1_800, 10**7])
def test_alerts_keep_their_distance(spark, cooldown):
    rows = alert_rows()
    got = P.cooled_alerts(spark.createDataFrame(rows, "symbol string, at long"), ["symbol"], "at", cooldown).collect()
    assert sorted((r.symbol, r.at) for r in got) == plain_alerts(rows, cooldown)


def test_adaptive_confidence_is_that_of_the_loop(spark):
    r = random.Random(9)
    decisions = [("ab"[k % 2], START + 30 * k, k, None if r.random() < 0.02 else r.random() * 0.45) for k in range(1_500)]
    outcomes = [("ab"[k % 2], START + 30 * r.randint(0, 1_500), k, "LIVE", r.choice([1.0, -1.0, -1.0, 0.0, None])) for k in range(60)]
    d = spark.createDataFrame(decisions, "symbol string, at long, id long, confidence double")
    got = {(x.symbol, x.id): (x.holds, round(x.minimum, 9), x.taken) for x in P.adaptive_confidence(d, frame(spark, outcomes)).collect()}
    want = {}
    for key in "ab":
        events = sorted([(at, 0, i, pnl) for k, at, i, _, pnl in outcomes if k == key and pnl] + [(at, 1, i, c) for k, at, i, c in decisions if k == key], key=lambda e: e[:3])
        holds = losses = strict = 0
        for _, kind, i, x in events:
            if kind == 0:
                losses, strict = (0, 0) if x > 0 else (losses + 1, 24)
                continue
            base = 0.40
            if strict > 0:
                base, strict = base + min(losses * 0.05, 0.15), strict - 1
            minimum = max(base - (holds - 60) * 0.005, 0.25) if holds > 60 else base
            taken = (x or 0.0) >= minimum
            want[key, i] = (holds, round(minimum, 9), taken)
            holds = 0 if taken else holds + 1
    assert got == want and max(w[0] for w in want.values()) > 65 and len({w[1] for w in want.values()}) > 5


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def replay(spark, tmp_path, rows, schema, make, parts):
    """Write the rows as one file a batch, stream them all, and return what comes out."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        piece = [(*r[:1], datetime.fromtimestamp(r[1], timezone.utc), *r[2:]) for r in rows[k * size : (k + 1) * size]]
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"{k:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    query = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]


def test_stream_of_pauses_equals_the_table(spark, rocks, tmp_path):
    rules = P.PauseRules(soft_wins=2)
    rows = sorted(trade_rows(1, 240, ("a", "b")), key=lambda x: x[1])
    far = rows[-1][1] + 30 * P.DAY
    rows.append(("z", far, 10_000, "PAPER", 1.0))
    got = replay(spark, tmp_path, rows, "symbol string, ts timestamp, id long, mode string, pnl double", lambda s: SP.stream_loss_pauses(s, rules=rules), 6)
    want = plain_pauses(rows[:-1], rules)
    horizon = {k: max(r[1] for r in rows[:-1] if r[0] == k and r[3]) + rules.hard for k in "ab"}
    assert sorted(g for g in got if g[1] <= horizon[g[0]]) == want and len(want) > 4
    table = P.loss_pauses(frame(spark, rows[:-1]), rules=rules).collect()
    assert sorted(map(tuple, table), key=repr) == sorted((g for g in got if g[1] <= horizon[g[0]]), key=repr)


def test_stream_of_alerts_equals_the_table(spark, rocks, tmp_path):
    rows = [*alert_rows(), ("z", START + 10**7)]
    got = replay(spark, tmp_path, rows, "symbol string, ts timestamp", lambda s: SP.stream_cooled_alerts(s, "symbol", 1_800), 5)
    assert sorted(g for g in got if g[0] != "z") == plain_alerts(rows[:-1], 1_800)


def test_stretches_that_are_folded_together_are_those_of_the_loop(spark, monkeypatch):
    monkeypatch.setattr(P, "STRETCHES", 3)
    r = random.Random(11)
    rows = [(k % 3, START + 30 * k, k, r.choice([None, float("nan"), *[r.random() * 0.41] * 8])) for k in range(1_500)]
    rows = [(None if key == 2 else key, *x) for key, *x in rows]
    d = spark.createDataFrame(rows, "symbol long, at long, id long, confidence double")
    none = spark.createDataFrame([], "symbol long, at long, id long, pnl double")
    got = {(x.symbol, x.id): (x.holds, round(x.minimum, 9), x.taken) for x in P.adaptive_confidence(d, none, patience=20).collect()}
    want = {}
    for key in (0, 1, None):
        holds = 0
        for symbol, _, i, c in rows:
            if symbol == key:
                c = 0.0 if c is None or c != c else c
                minimum = max(0.40 - (holds - 20) * 0.005, 0.25) if holds > 20 else 0.40
                want[key, i] = (holds, round(minimum, 9), c >= minimum)
                holds = 0 if c >= minimum else holds + 1
    assert got == want
