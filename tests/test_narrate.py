"""Sentences are kept only if the facts bear them out."""

from test_indicators import make_bars, walk

from barline.functions import formats
from barline.operators import narrate
from barline.operators.score import HORIZONS, beta, features, latest, scan, score, signals
from barline.plans.indicator_queries import squeeze
from pyspark.sql import functions as F


def test_verified(spark):
    facts = spark.createDataFrame([("sleeve.trend", "trend", -0.4, None, None), ("count.BUY", "buys", 12.0, None, None), ("top", "top", None, [3.5, 1234.0], None)], narrate.FACTS)
    rows = [
        (1, "There are 12 buys.", ["count.BUY"], "fact", None), (2, "There are 13 buys.", ["count.BUY"], "fact", "holds other numbers"), (3, "Trend is a strong tailwind.", ["sleeve.trend"], "fact", "wrong direction"),
        (4, "Trend weighs at -0.4.", ["sleeve.trend"], "fact", None), (5, "The 2 values are 3.5 and 1,234.", ["top"], "fact", None), (6, "Rates fell.", ["count.BUY"], "external", "outside knowledge"),
        (7, "Nothing cited.", [], "fact", "cites no facts"), (8, "Unknown.", ["nope"], "fact", "cites unknown facts"), (9, " ", ["top"], "fact", None), (10, "Only 12.1 buys.", ["count.BUY"], "fact", None),
    ]
    sentences = spark.createDataFrame([r[:4] for r in rows], "sid int, text string, cited array<string>, claim string")
    got = {r.sid: r.reason for r in narrate.verified(sentences, facts).collect()}
    assert got == {r[0]: r[4] for r in rows if r[1].strip()}
    assert [r.sid for r in narrate.verified(sentences, facts, 2).where("reason IS NULL").collect()] == [1, 4]


def test_numbers_as_text(spark):
    """What a brief's hash rests on: values of ten millions and more are written without a power of ten, as DuckDB writes them."""
    import duckdb

    values = [0.0, -0.0, 1.0, 40.0, 0.167, 1e7, -1e7, 12345678.25, -98765432.1, 123456789012345.6, 1e15, 9999999999999998.0, 1e16, 1.5e17, -1.5e300, 0.001, 0.0001, 0.00012, 0.00001, -1.5e-7, 1e-300, float("nan"), float("inf"), float("-inf")]
    want = duckdb.connect().execute("SELECT v, CAST(v AS VARCHAR) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()
    got = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, v double").select("i", formats.number(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [*(t for _, t in want), None]


def test_facts_hash_of_large_values(spark):
    from hashlib import sha256

    facts = spark.createDataFrame([("market.risk", "m", None, None, "on"), ("rebalance.net_cash", "c", -12345678.25, None, None)], narrate.FACTS)
    got = narrate.brief(facts).first()
    assert got.facts_hash == sha256(b"market.risk|on\nrebalance.net_cash|-12345678.25").hexdigest()[:12]


def test_facts_signals_and_beta(spark):
    bars = make_bars(spark, {"A": walk(330, 1), "B": walk(330, 2)})
    facts = narrate.scan_facts(scan(bars, "1m"), "1m").collect()
    assert {"sleeve.trend", "sleeve.quality", "name.A", "name.B"} <= {r.id for r in facts}
    h = HORIZONS["1m"]
    twice = make_bars(spark, {"M": walk(330, 1)})
    from barline.functions.indicators import add

    t = beta(add(features(bars, h), "bb_up", "bb_low", "half_life126", "don_break"), twice)
    t = score(latest(squeeze(t).withColumns({"_fired": F.lit(False), "_below": F.lit(False), "_above": F.lit(False)})), h).withColumn("signals", signals())
    rows = {r.symbol: r for r in latest(t.select("symbol", "date", "beta", "alpha", "signals")).collect()}
    assert abs(rows["A"].beta - 252 / 251) < 1e-6 and len(rows["A"].signals) <= 5
    assert t.where(F.size("signals") > 5).count() == 0
