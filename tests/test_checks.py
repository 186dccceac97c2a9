"""Checks of a book, their review, briefs, calibration, search and the normal distribution."""

import datetime
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions import factors, formats
from barline.operators import backtest as bt
from barline.operators import calibrate, checks, evaluate, narrate, regime
from barline.operators import portfolio as pf
from barline.operators.score import SLEEVES, WEIGHTS, load_weights

DAY = datetime.date(2024, 1, 1)


def book(spark, **weights):
    return spark.createDataFrame(list(weights.items()), "symbol string, weight double")


def test_concentration_and_review(spark):
    even = book(spark, **{f"N{i}": 0.1 for i in range(10)})
    one = checks.concentration(book(spark, A=0.5, B=0.3, C=0.2))
    assert checks.concentration(even).first().status == "pass" and one.first().status == "fail"
    warn = checks.exposure(spark.createDataFrame([(0.6, "neutral")], "exposure double, risk string"))
    got = checks.review([one, warn, checks.concentration(even)]).first()
    assert got.blocking and (got.n_fail, got.n_warn) == (1, 1) and [c.id for c in got.concerns] == ["concentration", "exposure"] and got.summary.startswith("1 failed")
    assert not checks.review([warn]).first().blocking and checks.review([checks.concentration(even)]).first().summary == "all 1 passed"
    proposed = spark.createDataFrame([("exposure", "x"), ("made_up", "y")], "check_id string, concern string")
    assert [r.check_id for r in checks.kept_concerns(proposed, warn).collect()] == ["exposure"]


def test_flags_are_logged(spark, tmp_path):
    row = checks.flags(checks.concentration(book(spark, A=1.0)), book(spark, A=1.0), "2024-01-01")
    for _ in range(2):
        checks.log_flags(row, str(tmp_path / "flags"))
    assert spark.read.json(str(tmp_path / "flags")).count() == 2


def returns(spark, paths):
    return spark.createDataFrame([(s, DAY + datetime.timedelta(days=k), float(v)) for s, p in paths.items() for k, v in enumerate(p)], "symbol string, date date, ret double")


def test_clusters(spark):
    g = np.random.default_rng(1)
    base = g.normal(size=80)
    paths = {s: base + 0.1 * g.normal(size=80) for s in "ABC"} | {s: g.normal(size=80) for s in "DE"} | {"F": base[:30]}
    r = returns(spark, paths)
    assert {tuple(x) for x in checks.clusters(r).collect()} == {(s, "A", 3) for s in "ABC"}
    assert checks.clusters(r, book(spark, A=0.5, D=0.5)).count() == 0
    got = checks.correlated(r, book(spark, A=0.2, B=0.2, C=0.1, D=0.5)).first()
    assert got.status == "warn" and got.value == pytest.approx(50)


def test_components_of_long_chains_and_clouds(spark):
    from barline.operators.links import components

    g = np.random.default_rng(7)
    names = [f"n{k:04d}" for k in g.permutation(400)]
    pairs = [(names[k], names[k + 1]) for k in range(299)] + [(names[300 + int(a)], names[300 + int(b)]) for a, b in g.integers(0, 100, (90, 2))]
    root = {s: s for p in pairs for s in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.symbol: r.head for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {s: find(s) for s in got} and {s for a, b in pairs if a != b for s in (a, b)} == set(got)


def test_earnings_regimes_and_separation(spark):
    day = spark.createDataFrame([(DAY,)], "today date")
    f = spark.createDataFrame([("A", DAY + datetime.timedelta(days=29)), ("B", DAY + datetime.timedelta(days=30)), ("C", DAY - datetime.timedelta(days=1))], "symbol string, next_earnings date")
    w = book(spark, A=0.3, B=0.3, C=0.4)
    assert checks.earnings(w, f, day).first().value == pytest.approx(30)
    scan = spark.createDataFrame([("A", "1m", "mixed"), ("B", "1m", "mixed")], "symbol string, period string, trend_state string")
    assert checks.regime_mix(w, scan).first().detail == "2 of 3 names are mixed"
    scores = spark.createDataFrame([(f"N{i}", float(i)) for i in range(12)], "symbol string, score double")
    top = book(spark, N11=0.5, N10=0.5)
    want = (10.5 - np.mean(range(10))) / np.std(range(12))
    assert checks.separation(scores, top).first().value == pytest.approx(want) and checks.separation(scores.limit(5), top).first().status == "skip"


def test_incumbents_stay_and_changes_are_named(spark):
    g = np.random.default_rng(2)
    n = 200
    rows = [(f"N{i}", "S", DAY + datetime.timedelta(days=k), c, c, c, c, 1.0) for i in range(8) for k, c in enumerate(100 * np.exp(np.cumsum(g.normal(0, 0.01, n))))]
    from barline.sources.bars import SCHEMA

    bars = spark.createDataFrame([(s, x, d, *map(float, v)) for s, x, d, *v in rows], SCHEMA)
    scan = spark.createDataFrame([(f"N{i}", "1m", 50.0 - i) for i in range(8)] + [("N0", "1d", 20.0)], "symbol string, period string, score double")
    positions = spark.createDataFrame([("N7", 10.0)], "symbol string, shares double")
    got = pf.recommend(scan, bars, positions, 0.6, ("N3", "N7"), None, 3)
    held = {r.symbol: r for r in got["holdings"].collect()}
    assert set(held) == {"N3", "N0", "N1"} and got["added"] == ["N0", "N1"] and got["dropped"] == ["N7"] and held["N0"].timing == "enter"
    assert sum(r.weight for r in held.values()) == pytest.approx(1) and sum(r.target_value for r in held.values()) == pytest.approx(0.6 * got["base"]) and got["cash_weight"] == pytest.approx(40)
    assert pf.recommend(scan.withColumn("score", -F.col("score")), bars, positions)["holdings"].count() == 0


def test_benchmarks_weights_and_gate(spark):
    rows = [(k, DAY + datetime.timedelta(days=7 * k), f"N{i}", float(i), 10.0 * (i + 1), 0.01 * i) for k in range(4) for i in range(10)]
    panel = spark.createDataFrame(rows, "k int, date date, symbol string, s double, vol double, fwd double")
    held = bt.holding_weights(bt.holdings(panel, ["s"], 0.3, ("vol",))).where("k = 0").collect()
    raw = {r.symbol: 1 / r.vol for r in held}
    assert all(r.weight == pytest.approx(raw[r.symbol] / sum(raw.values()), abs=0.05) for r in held)
    half = panel.select("date").distinct().withColumn("exposure", F.lit(0.5))
    plain = {r.k: r.ret for r in bt.strategy_returns(panel, ["s"]).collect()}
    assert all(r.ret == pytest.approx(plain[r.k] / 2) for r in bt.strategy_returns(panel, ["s"], exposure=half).collect())
    dates = panel.select("k", "date").distinct().withColumn("bench_ret", F.lit(0.02))
    got = {(r.strategy, r.k): r.ret for r in bt.benchmarks(panel, dates).collect()}
    assert got["equal_weight", 0] == pytest.approx(0.045) and got["market", 3] == 0.02


def test_normal_distribution(spark):
    z = [float(x) for x in np.linspace(-9, 9, 181)] + [4.2426, -4.2427]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", evaluate.normal_cdf(F.col("z")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(NormalDist().cdf(r.z) if r.z > -5 else 0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-9, abs=1e-15)
    assert evaluate.normal_ppf(0.975) == pytest.approx(1.959963984540054)
    with pytest.raises(ValueError):
        evaluate.normal_ppf(1.0)


def test_deflated_t(spark):
    got = {r.strategy: r for r in evaluate.deflated_t(spark.createDataFrame([("a", 3.0), ("b", -3.0), ("c", 1.0)], "strategy string, t double"), 35).collect()}
    assert got["a"].hurdle == pytest.approx(math.sqrt(2 * math.log(35)))
    assert [(got[s].passes, got[s].clears_positive) for s in "abc"] == [(True, True), (True, False), (False, False)]


def test_calibration_finds_the_sleeve_that_works(spark):
    g = np.random.default_rng(3)
    rows = []
    for k in range(60):
        for i in range(12):
            s = g.normal(size=5)
            rows.append((k, DAY + datetime.timedelta(days=7 * k), f"N{i:02}", *map(float, s), "mixed", float(0.02 * s[4] + 0.01 * g.normal())))
    panel = spark.createDataFrame(rows, "k int, date date, symbol string, " + ", ".join(f"{s} double" for s in SLEEVES) + ", state string, fwd double").withColumnRenamed("state", "trend_state")
    got = calibrate.calibration(panel, WEIGHTS, "trend_state", 0.6)
    assert got["accepted"] and got["weights"]["mixed"]["quality"] > 0.5 and got["report"].count() == 4
    assert got["weights"]["trending"] == pytest.approx(WEIGHTS["trending"], abs=1e-3)


def test_states_are_scaled_by_all_rows_so_far():
    g = np.random.default_rng(4)
    x = g.normal(size=(330, 7))
    x[150:] += 2
    x[5, 3] = np.nan
    got = regime.walk_forward(x, least=252, refit=21)
    persistent = [regime.FEATURES.index(f) for f in regime.PERSISTENCE]
    for i in (260, 272, 290, 329):
        start = 252 + (i - 252) // 21 * 21
        centers, path, _ = regime.fit_jump_model(regime.Scale(x).until(start), 3, 20.0, seed=0)
        names = {int(k): regime.STATES[j] for j, k in enumerate(np.argsort(-centers[:, persistent].mean(1), kind="stable"))}
        cost = regime.distances(regime.Scale(x).until(i), centers)
        total = cost[0].copy()
        for t in range(1, len(cost)):
            total = np.minimum(total, total.min() + 20.0) + cost[t]
        assert got[i] == (names[int(path[-1])] if i == start else names[int(total.argmin())])


def test_proposals_are_in_the_language():
    got = factors.propose_random(30, 7)
    assert len({factors.canonical(t) for t in got}) == len(got) == 30 and got == factors.propose_random(30, 7) != factors.propose_random(30, 8)


def test_weights_from_a_file(spark, tmp_path):
    import json

    path = str(tmp_path / "w.json")
    assert load_weights(spark, path) == WEIGHTS
    (tmp_path / "w.json").write_text(json.dumps({s: {k: 0.2 for k in SLEEVES} for s in WEIGHTS}))
    assert load_weights(spark, path)["mixed"]["trend"] == 0.2
    (tmp_path / "w.json").write_text(json.dumps({"mixed": {"trend": 1}}))
    assert load_weights(spark, path) == WEIGHTS


def test_formats(spark):
    t = spark.createDataFrame([(0.05, "2024-01-02"), (12.5, "2024-01-02 03:04:05"), (1234567.8, "x"), (None, None)], "x double, t string")
    got = t.select(formats.price(F.col("x")).alias("p"), formats.percentage(F.col("x")).alias("q"), formats.day(F.col("t")).alias("d")).collect()
    assert [r.p for r in got] == ["$0.050000", "$12.50", "$1,234,567", "N/A"] and got[1].q == "+12.50%" and got[3].q == "N/A"
    assert got[1].d == datetime.datetime(2024, 1, 2, 3, 4, 5) and got[2].d is None


def test_brief(spark):
    facts = spark.createDataFrame([("market.risk", "m", None, None, "off"), ("portfolio.n_names", "n", 6.0, None, None), ("portfolio.added", "a", 1.0, None, "ABC"), ("portfolio.dropped", "d", 0.0, None, "nothing"), ("sleeve.trend", "t", -0.4, None, None), ("sleeve.quality", "q", 0.3, None, None)], narrate.FACTS)
    got = narrate.brief(facts).first()
    assert got.n_rejected == 0 and "The market is off." in got.text and "The quality sleeve reads 0.300, the trend sleeve -0.400." in got.text and got.n_facts == 6
    wild = spark.createDataFrame([(0, "Everything doubles to 99.", ["market.risk"], "data")], narrate.SENTENCES)
    back = narrate.brief(facts, wild).first()
    assert back.n_kept == 4 and back.n_rejected == 1 and back.rejected_share == pytest.approx(0.2)


def test_queries_of_several_branches_read_the_trades_once(spark):
    """Their plans rest on bars, dates and weights that were written, not on the trades again."""
    from barline.plans import composite_queries, portfolio_queries

    folder = "/root/testdata/sf0.001"
    found, rec = portfolio_queries.run_checks(spark, folder)
    bars, dates = composite_queries.bars_and_dates(spark, folder)
    for table in (found, rec["trades"], rec["holdings"], bars, dates, composite_queries.composite_panel(bars, dates)):
        assert not [f for f in table.inputFiles() if "lineitem" in f]
    assert found.count() == 7
