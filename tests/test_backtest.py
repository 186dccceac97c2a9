"""As-of join, portfolios, costs, ranks and audits on small literal tables."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import backtest as bt
from barline.operators import cross
from barline.operators import portfolio as pf
from barline.operators.asof import pad

DAY = datetime.date(2024, 1, 1)


def day(k):
    return DAY + datetime.timedelta(days=k)


def test_pad_takes_the_last_bar(spark):
    bars = spark.createDataFrame([("A", day(0), 1.0), ("A", day(5), 2.0), ("B", day(9), 3.0)], "symbol string, date date, close double")
    asked = spark.createDataFrame([("A", day(k), k) for k in (-1, 0, 4, 5, 30)] + [("B", day(8), 8)], "symbol string, date date, k int")
    assert sorted((r.symbol, r.k, r.close) for r in pad(bars, asked, ["close"]).collect()) == [("A", 0, 1.0), ("A", 4, 1.0), ("A", 5, 2.0), ("A", 30, 2.0)]


def test_a_panel_joined_with_itself_keeps_its_rows(spark):
    from barline.functions.indicators import add
    from barline.sources.scratch import held

    rows = [(f"S{s}", day(d), 100.0 + d % 7 + s) for s in range(9) for d in range(340)]
    bars = add(held(spark.createDataFrame(rows, "symbol string, date date, close double")), "n_bar")
    dates = held(spark.createDataFrame([(k, day(310 + 5 * k), day(315 + 5 * k)) for k in range(4)], "k int, date date, next_date date"))
    table = bt.panel(bars.withColumn("v", 2 * F.col("close")), dates, ["v"], bars)
    at = lambda s, d: 100.0 + d % 7 + s
    want = sorted((k, f"S{s}", 2 * at(s, 310 + 5 * k), at(s, 315 + 5 * k) / at(s, 310 + 5 * k) - 1, 9) for s in range(9) for k in range(4))
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            got = table.join(table.groupBy("k").agg(F.count("*").alias("n")), "k").collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        assert sorted((r.k, r.symbol, r.v, r.fwd, r.n) for r in got) == want


def panel(spark, dates=12, names=15, seed=1):
    g = np.random.default_rng(seed)
    rows = [(k, day(7 * k), f"N{i:02}", float(f), float(g.normal()), float(f)) for k in range(dates) for i in range(names) for f in [g.normal(0, 0.02)]]
    return spark.createDataFrame(rows, "k int, date date, symbol string, oracle double, noise double, fwd double")


def test_a_perfect_signal(spark):
    p = panel(spark)
    ics = {r.strategy: r for r in bt.ic_stats(bt.information_coefficients(p, ["oracle", "noise"])).collect()}
    assert ics["oracle"].mean == pytest.approx(1) and abs(ics["noise"].mean) < 0.5
    tenths = {r.decile: r.ann_return for r in bt.deciles(p, "oracle").collect()}
    assert sorted(tenths) == list(range(1, 11)) and tenths[10] > tenths[5] > tenths[1]


def test_returns_turnover_and_costs(spark):
    p = panel(spark)
    r = bt.strategy_returns(p, ["oracle"])
    rows = {x.k: x for x in r.collect()}
    for k in range(12):
        best = sorted((x.fwd for x in p.where(F.col("k") == k).collect()), reverse=True)[:3]
        assert rows[k].ret == pytest.approx(np.mean(best))
    assert rows[0].turnover == 0 and all(0 <= x.turnover <= 1 for x in rows.values())
    paid = {x.k: x.ret for x in bt.after_costs(r, 10).collect()}
    assert paid[3] == pytest.approx(rows[3].ret - 2 * rows[3].turnover * 0.001)
    s = bt.stats(r).first()
    eq = np.cumprod([1 + rows[k].ret for k in range(12)])
    assert s.total == pytest.approx(100 * (eq[-1] - 1)) and s.max_dd == pytest.approx(100 * (eq / np.maximum.accumulate(eq) - 1).min())


def test_few_names_return_nothing(spark):
    assert {x.ret for x in bt.strategy_returns(panel(spark, names=4), ["oracle"]).collect()} == {0.0}


def test_overfitting_of_a_real_winner(spark):
    g = np.random.default_rng(3)
    rows = [("w" if s == 0 else f"s{s}", k, float(g.normal(0.02 if s == 0 else 0, 0.01))) for s in range(6) for k in range(103)]
    got = bt.overfitting(spark.createDataFrame(rows, "strategy string, k int, ret double")).first()
    assert got.splits == 252 and got.pbo == 0


def test_ranks_with_ties(spark):
    t = spark.createDataFrame([("1m", f"S{i}", float(v)) for i, v in enumerate([1, 2, 2, 3])] + [("1y", "X", 5.0)], "period string, symbol string, score double")
    got = {(r.period, r.symbol): r["rank"] for r in cross.percentile_rank(t).collect()}
    assert got["1y", "X"] == 5 and got["1m", "S1"] == got["1m", "S2"] and got["1m", "S3"] == 1 and got["1m", "S0"] == 8


def test_filter_falls_back_to_everything(spark):
    t = spark.createDataFrame([("A", "1m", 9, "HOLD"), ("B", "1m", 8, "SELL")], "symbol string, period string, rank int, recommendation string")
    assert cross.filtered(t, only_buys=True).count() == 2
    assert cross.filtered(t, ranks_above=9).count() == 1


def test_weights_keep_the_cap(spark):
    names = spark.createDataFrame([(f"N{i}", 50.0 if i == 0 else 0.0) for i in range(10)], "symbol string, score double")
    g = np.random.default_rng(2)
    returns = spark.createDataFrame([(f"N{i}", day(k), float(g.normal(0, 0.002 if i == 0 else 0.02))) for i in range(10) for k in range(60)], "symbol string, date date, ret double")
    w = {r.symbol: r.weight for r in pf.capped(pf.inverse_vol(returns, names)).collect()}
    assert sum(w.values()) == pytest.approx(1) and max(w.values()) == pytest.approx(0.15, abs=1e-6)


def test_selection_skips_twins_and_keeps_incumbents(spark):
    scores = spark.createDataFrame([("A", 9.0), ("B", 8.0), ("C", 7.0), ("D", -1.0)], "symbol string, score double")
    pairs = spark.createDataFrame([("A", "B", 0.99), ("A", "C", 0.1), ("B", "C", 0.1)], "a string, b string, corr double")
    assert pf.select_names(scores, pairs, most=3) == ["A", "C"]
    assert pf.select_names(scores, pairs, ["B"], most=3) == ["B", "C"]


def test_selection_goes_on_past_many_twins(spark):
    """200 near twins of the best name stand ahead of the last ones that fit."""
    rows = [("A", 999.0)] + [(f"T{k:03d}", 900.0 - k) for k in range(200)] + [("Y", 5.0), ("Z", 5.0), ("W", 0.0)]
    scores = spark.createDataFrame(rows, "symbol string, score double")
    pairs = spark.createDataFrame([("A", t, 0.99) for t, _ in rows[1:201]] + [("Y", "Z", 0.1)], "a string, b string, corr double")
    assert pf.select_names(scores, pairs, most=3) == ["A", "Y", "Z"] == pf.select_names(scores, pairs, most=3, page=7)


def test_full_exit_uses_held_shares(spark):
    target = spark.createDataFrame([("A", 1.0)], "symbol string, weight double")
    held = spark.createDataFrame([("B", 3.333, 100.0)], "symbol string, shares double, value double")
    prices = spark.createDataFrame([("A", 10.0), ("B", 31.0)], "symbol string, price double")
    got = {r.symbol: r for r in pf.rebalance(target, held, prices, 1000.0).collect()}
    assert got["B"].delta_shares == -3.333 and got["B"].action == "sell" and got["A"].delta_shares == 100


def test_stream_equals_batch(spark, tmp_path):
    from barline.streaming.bars import read_events, windowed_bars

    rows = [(i, datetime.datetime(2024, 1, 1, i // 10, i % 10), 1, "ab"[i % 2], float(i * 7 % 13), "{}") for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_bars(read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    key = lambda r: (r.symbol, r.window_start)
    assert sorted(spark.table("bars_out").collect(), key=key) == sorted(windowed_bars(events).collect(), key=key)


def test_selection_sees_names_beyond_the_tenth(spark, monkeypatch):
    from barline.plans import book_queries

    scores = spark.createDataFrame([(f"S{i:02}", 100.0 - i) for i in range(20)], "symbol string, score double")
    pairs = spark.createDataFrame([("S00", f"S{i:02}", 0.9) for i in range(1, 10)], "a string, b string, corr double")
    monkeypatch.setattr(book_queries, "derive_bars", lambda *_: scores)
    monkeypatch.setattr(book_queries, "add", lambda bars, *_: bars.withColumn("zscore20", F.col("score") / 100))
    monkeypatch.setattr("barline.operators.score.latest", lambda bars: bars)
    monkeypatch.setattr(book_queries.pf, "recent_returns", lambda bars: bars)
    monkeypatch.setattr(book_queries.pf, "pair_correlations", lambda _: pairs)
    assert [r.symbol for r in book_queries.selection_query(spark, "").orderBy("place").collect()] == ["S00", "S10", "S11", "S12", "S13"]
