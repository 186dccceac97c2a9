"""Stored histories, runs, values and logs."""

import datetime
import json

from barline.sources import store
from barline.sources.bars import SCHEMA

DAY = datetime.date(2024, 1, 1)


def bars(spark, *rows):
    return spark.createDataFrame([(s, "X", DAY + datetime.timedelta(days=k), c, c, c, c, 1.0) for s, k, c in rows], SCHEMA)


def test_versions_of_a_table(spark, tmp_path):
    root = str(tmp_path)
    assert store.opened(spark, root, "prices").count() == 0
    store.replaced(bars(spark, ("A", 0, 1.0)), root, "prices")
    store.replaced(store.stored_history(store.opened(spark, root, "prices"), bars(spark, ("A", 1, 2.0), ("A", 0, 3.0), ("B", 0, None))), root, "prices")
    assert sorted((r.symbol, r.close) for r in store.opened(spark, root, "prices").collect()) == [("A", 2.0), ("A", 3.0)]


def test_replacing_a_history(spark):
    old = bars(spark, ("A", 0, 1.0), ("A", 1, 1.0), ("B", 0, 1.0))
    got = store.stored_history(old, bars(spark, ("A", 5, 9.0)), replace=True)
    assert sorted((r.symbol, r.close) for r in got.collect()) == [("A", 9.0), ("B", 1.0)]


def test_fetch_plan(spark):
    held = bars(spark, ("A", 9, 1.0), ("B", 9, 1.0), ("C", 9, 1.0))
    meta = store.marked(spark.createDataFrame([], "key string, value string"), spark.createDataFrame([("A",), ("B",)], "symbol string"), 100.0, full=True)
    meta = store.put(meta, spark.createDataFrame([("fetch:B", "-5000.0")], "key string, value string"))
    names = spark.createDataFrame([(s,) for s in "ABCD"], "symbol string")
    plan = {r.symbol: (r.plan, r.start) for r in store.fetch_plan(held, meta, names, 200.0).collect()}
    assert plan == {"A": ("cache", None), "B": ("recent", DAY + datetime.timedelta(days=2)), "C": ("full", None), "D": ("full", None)}
    late = {r.symbol: r.plan for r in store.fetch_plan(held, meta, names, 100.0 + store.FULL_SECONDS + 1).collect()}
    assert late["A"] == late["B"] == "full"


def test_runs_are_kept_and_read_back(spark):
    runs, history = (spark.createDataFrame([], store.TABLES[n]) for n in ("runs", "score_history"))
    for k in range(3):
        scan = spark.createDataFrame([("A", "1m", 10.5 + k, 1, "BUY"), ("B", "1m", None, 2, "HOLD")], "symbol string, period string, score double, rank int, recommendation string")
        runs, history = store.saved_run(runs, history, scan, 100.0 + k)
        runs, history = spark.createDataFrame(runs.collect(), runs.schema), spark.createDataFrame(history.collect(), history.schema)
    assert [r.id for r in runs.orderBy("id").collect()] == [1, 2, 3] and history.count() == 3
    last = store.latest_run(runs, 110.0, 60).orderBy("symbol").collect()
    assert [(r.id, r.symbol, r.score) for r in last] == [(3, "A", 12.5), (3, "B", None)]
    assert store.latest_run(runs, 1000.0, 60).count() == 0
    assert [r.score for r in store.history_of(history, "A").collect()] == [10.5, 11.5, 12.5] and store.run_before(history, 3).first()["rank"] == 1


def test_fundamentals_age(spark):
    table = store.saved_fundamentals(spark.createDataFrame([("A", "{}", 0.0)], store.TABLES["fundamentals"]), spark.createDataFrame([("B", '{"pe": 3}')], "symbol string, data string"), 50.0)
    assert [(r.symbol, r.age) for r in store.fundamentals_of(table, 60.0, 20).collect()] == [("B", 10.0)]


def test_logs_survive_broken_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    a = store.log_trial(spark, {"x": 1, "y": 2}, {"t": 1.0}, path)
    assert a == store.log_trial(spark, {"y": 2, "x": 1}, {"t": 2.0}, path) and len(a) == 12
    spark.createDataFrame([("{broken",), ("",), ("[1]",)], "value string").write.mode("append").text(path)
    log = store.lines(spark.read.text(path))
    assert store.trials(log).first().asDict() == {"total": 4, "distinct_trials": 1} and store.sound(log).count() == 2
    assert store.trials(log.limit(0)).first().distinct_trials == 1


def test_config_and_summary(spark, tmp_path):
    path = str(tmp_path / "config")
    assert store.load_config(spark, path) == store.DEFAULTS
    store.save_config(spark, {"most": 5}, path)
    assert store.load_config(spark, path)["most"] == 5
    spark.createDataFrame([("[1",)], "value string").write.mode("overwrite").text(path)
    assert store.load_config(spark, path) == store.DEFAULTS
    store.summary_json(spark.createDataFrame([("s", 1.0, 2.0)], "strategy string, sharpe double, equity double"), str(tmp_path / "summary"))
    assert json.loads(spark.read.text(str(tmp_path / "summary")).first()[0]) == {"strategy": "s", "sharpe": 1.0}


def test_batches_merge_into_months(spark, tmp_path):
    from barline.streaming.bars import current, upsert_into

    path = str(tmp_path / "bars")
    merge = upsert_into(path)
    assert current(spark, path).count() == 0
    merge(bars(spark, ("A", 0, 1.0), ("A", 40, 2.0), ("B", 0, 5.0)), 0)
    for _ in range(2):  # a repeated batch changes nothing
        merge(bars(spark, ("A", 0, 9.0), ("C", 1, 3.0)), 1)
    merge(bars(spark), 2)
    got = sorted((r.symbol, r.date, r.close) for r in current(spark, path).collect())
    day = lambda k: DAY + datetime.timedelta(days=k)
    assert got == [("A", day(0), 9.0), ("A", day(40), 2.0), ("B", day(0), 5.0), ("C", day(1), 3.0)]
    assert not (tmp_path / "bars/v1/month=2024-02").exists()


def test_the_last_recommendation_is_carried(spark):
    meta = spark.createDataFrame([("fetch:A", "1.0")], store.TABLES["meta"])
    assert store.last_recommended(meta).count() == 0
    meta = store.remembered(store.remembered(meta, ["B", "A"], 1.0), ["C", "B"], 2.0)
    assert sorted(map(tuple, store.last_recommended(meta).collect())) == [("B", 2.0), ("C", 2.0)]
    assert sorted(r.key for r in meta.collect()) == ["fetch:A", store.RECOMMENDED]
    assert store.last_recommended(store.remembered(meta, [], 3.0)).count() == 0
    broken = store.put(meta, spark.createDataFrame([(store.RECOMMENDED, "{")], store.TABLES["meta"]))
    assert store.last_recommended(broken).count() == 0
