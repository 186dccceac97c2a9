"""Queries of storage, portfolio, risk, market state, factor expressions and ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import factors
from ..functions.indicators import add
from ..operators import cross
from ..operators import checks
from ..operators import portfolio as pf
from ..sources import bars as src
from ..sources import store
from ..sources.bars import derive_bars, held_bars, market
from ..sources.scratch import held
from . import indicator_sql as sql
from .backtest_queries import rounded

EXPRESSIONS = {
    "reversal": "-zscore(close, 20)",
    "trend_rank": "ts_rank(close, 10) - 0.5",
    "squashed_flow": "tanh(ts_mean(cmf20, 5) * 3) + sign(ts_delta(volume, 5))",
    "calm_momentum": "clip(pct_change(close, 21), -1, 1) / (ts_std(ret1, 21) + 0.01)",
    "range_log": "logv(ts_max(high, 10) / ts_min(low, 10)) - ts_sum(ret1, 10)",
}
CUTOFF, BASE = "1992-01-05", 100_000.0


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def point_query(spark, sf_dir) -> DataFrame:
    return src.point_history(derive_bars(spark, sf_dir), "NATION_1")


def upsert_query(spark, sf_dir) -> DataFrame:
    bars = held_bars(spark, sf_dir)
    last = F.max("date").over(Window.partitionBy("symbol"))
    fresh = bars.withColumn("last", last).where(F.date_diff("last", "date") < 7).withColumns({"close": F.col("high"), "volume": F.col("volume") + 1}).drop("last")
    more = fresh.withColumn("date", F.date_add("date", 7))
    return src.upsert(bars, fresh.unionByName(more))


def stale_query(spark, sf_dir) -> DataFrame:
    return src.stale_symbols(derive_bars(spark, sf_dir), CUTOFF)


def universe_query(spark, sf_dir) -> DataFrame:
    return src.long_enough(derive_bars(spark, sf_dir), 600).groupBy("symbol").agg(F.count("*").alias("n"))


def runs(spark, sf_dir) -> DataFrame:
    """(run_id, symbol, score, rank): a run at each quarter's end, by the quarter's change of the close."""
    q = derive_bars(spark, sf_dir).groupBy("symbol", F.date_trunc("quarter", "date").cast("date").alias("quarter")).agg(F.max_by("close", "date").alias("close"))
    q = q.withColumn("score", F.ln(F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("quarter")))).where("score IS NOT NULL")
    first = F.date_diff("quarter", F.lit("1970-01-01").cast("date"))
    ranked = cross.percentile_rank(q.withColumn("period", F.col("quarter")))
    return ranked.select((F.round(first / 91.3125)).cast("int").alias("run_id"), "symbol", "score", "rank")


def runs_kept_query(spark, sf_dir) -> DataFrame:
    r = runs(spark, sf_dir)
    newest = r.select("run_id").distinct().orderBy(F.desc("run_id")).limit(store.KEPT_RUNS)
    return rounded(r.join(newest, "run_id", "left_semi"))


def previous_ranks_query(spark, sf_dir) -> DataFrame:
    r = runs(spark, sf_dir)
    last = r.agg(F.max("run_id").alias("last"))
    before = r.join(F.broadcast(last)).where(F.col("run_id") < F.col("last"))
    return before.groupBy("symbol").agg(F.max("run_id").alias("run_id"), F.max_by("rank", "run_id").alias("rank"))


def history_query(spark, sf_dir) -> DataFrame:
    by = Window.partitionBy("symbol").orderBy(F.desc("run_id"))
    return rounded(runs(spark, sf_dir).withColumn("i", F.row_number().over(by)).where("i <= 8").drop("i"))


def trial_log(spark, sf_dir) -> DataFrame:
    """A log of trials as text: a JSON line for each event, one in ten of them cut off."""
    e = table(spark, sf_dir, "events")
    digest = F.substring(F.sha2(F.concat_ws("|", "event_type", "props"), 256), 1, 12)
    line = F.to_json(F.struct(digest.alias("hash"), F.col("event_type").alias("expression"), F.when(F.col("value") > 50, "pass").otherwise("weak").alias("verdict")))
    return e.select(F.when(F.col("event_id") % 10 == 3, F.substring(line, 1, 20)).otherwise(line).alias("value"))


def ledger_query(spark, sf_dir) -> DataFrame:
    """Trials in all, and distinct ones by the digest of their configuration."""
    return store.trials(store.lines(trial_log(spark, sf_dir)))


def candidates_query(spark, sf_dir) -> DataFrame:
    return store.sound(store.lines(trial_log(spark, sf_dir))).groupBy("verdict", "expression").agg(F.count("*").alias("n"))


NOW = 1_000_000.0


def metadata(spark, sf_dir) -> DataFrame:
    """When each symbol was fetched, and fetched whole; one in seven never."""
    n = table(spark, sf_dir, "nation").where("n_nationkey % 7 <> 6")
    keys = F.array(F.struct(F.lit("fetch").alias("kind"), (NOW - F.col("n_nationkey") * 300).alias("at")), F.struct(F.lit("full").alias("kind"), (NOW - F.col("n_nationkey") * 50_000).alias("at")))
    return n.select("n_name", F.inline(keys)).select(F.concat_ws(":", "kind", "n_name").alias("key"), F.col("at").cast("string").alias("value"))


def _plan(spark, sf_dir) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol")).unionByName(spark.createDataFrame([("NEW",)], "symbol string"))
    return store.fetch_plan(derive_bars(spark, sf_dir), metadata(spark, sf_dir), names, NOW)


def fetched_query(spark, sf_dir) -> DataFrame:
    """Histories after each symbol's plan has brought the last 20 days at other prices."""
    bars = held_bars(spark, sf_dir)
    late = bars.withColumn("last", F.max("date").over(Window.partitionBy("symbol"))).where(F.date_diff("last", "date") <= 20).withColumn("close", F.col("close") + 1).drop("last")
    got = store.fetched(bars, _plan(spark, sf_dir), late)
    return rounded(got.groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.sum("close").alias("total")), 2)


def meta_query(spark, sf_dir) -> DataFrame:
    fresh = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("symbol"))
    return store.marked(metadata(spark, sf_dir), fresh, NOW, full=False)


def backfill_query(spark, sf_dir) -> DataFrame:
    bars = held_bars(spark, sf_dir)
    cut = bars.where((F.col("date") >= "1993-06-01") | (F.substring("symbol", -1, 1) > "4"))
    return store.backfill_plan(cut, bars.select("symbol"), "1999-04-01")


def _history(spark, sf_dir) -> DataFrame:
    return runs(spark, sf_dir).select(F.col("run_id").cast("long").alias("run_id"), (F.col("run_id") * 86400.0).alias("ts"), "symbol", F.lit("1m").alias("period"), "score", "rank", cross.rank_label(F.col("rank")).alias("recommendation"))


def _saved(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The runs so far as stored documents, and one run more: the last one's scores turned round."""
    history = _history(spark, sf_dir)
    row = F.struct("symbol", "period", "score", "rank", "recommendation")
    stored = history.groupBy(F.col("run_id").alias("id"), "ts").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("universe"), F.to_json(F.array_sort(F.collect_list(row))).alias("results"))
    last = history.withColumn("top", F.max("run_id").over(Window.partitionBy())).where("run_id = top")  # a run's few rows
    return store.saved_run(stored, history, last.withColumn("score", -F.col("score")).withColumn("rank", 11 - F.col("rank")), NOW)


def saved_query(spark, sf_dir) -> DataFrame:
    kept, history = _saved(spark, sf_dir)
    return kept.select(F.col("id").alias("run_id"), F.size(F.split("universe", ",")).alias("names")).join(history.groupBy("run_id").agg(F.count("*").alias("rows")), "run_id", "full")


def latest_run_query(spark, sf_dir) -> DataFrame:
    return rounded(store.latest_run(_saved(spark, sf_dir)[0], NOW + 60, 3600).drop("ts"), 5)


def served_query(spark, sf_dir) -> DataFrame:
    """What the newest run answers of five requests: two it can, one too late, one for an unknown symbol, one for a period that nobody has."""
    saved, some = _saved(spark, sf_dir)[0], ["NATION_1", "NATION_3"]
    asked = {"both": (some, ["1m"], 60), "one": (some[:1], ["1m"], 3600), "late": (some, ["1m"], 3601), "unknown": ([*some, "NOWHERE"], ["1m"], 60), "period": (some, ["1m", "6m"], 60)}
    parts = [store.served(saved, s, p, NOW + later, 3600).select(F.lit(name).alias("request"), "id", "symbol", "period", "rank") for name, (s, p, later) in asked.items()]
    return reduce(DataFrame.unionByName, parts)


def stored_fundamentals_query(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol"), F.to_json(F.struct(F.col("n_nationkey").alias("pe"))).alias("data"), (NOW - F.col("n_nationkey") * 40_000.0).alias("fetched_at"))
    fresh = n.where("symbol LIKE '%1%'").select("symbol", F.lit('{"pe":-1}').alias("data"))
    return store.fundamentals_of(store.saved_fundamentals(n, fresh, NOW), NOW)


def medians_query(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", (F.col("p_retailprice") / F.col("p_size")).alias("pe"))
    ok = (F.col("pe") > 0) & (F.col("pe") < 1e4)
    m = p.where(ok).groupBy("p_brand").agg(F.percentile("pe", F.lit(0.5)).alias("median_pe"))
    got = p.join(m, "p_brand").groupBy("p_brand").agg(F.first("median_pe").alias("median_pe"), F.count(F.when(F.col("pe") > 2 * F.col("median_pe"), 1)).alias("rich"), F.count(F.when(F.col("pe") < 0.5 * F.col("median_pe"), 1)).alias("cheap"))
    return rounded(got, 4)


def _scores(spark, sf_dir) -> DataFrame:
    """All names by their last 20-bar z-score, as (symbol, score)."""
    from ..operators.score import latest

    return latest(add(derive_bars(spark, sf_dir), "zscore20")).select("symbol", (100 * F.tanh("zscore20")).alias("score"))


def _names(spark, sf_dir) -> DataFrame:
    """The ten names of the best scores."""
    return _scores(spark, sf_dir).orderBy(F.desc("score"), "symbol").limit(10)


def pairs_query(spark, sf_dir) -> DataFrame:
    return rounded(pf.pair_correlations(pf.recent_returns(derive_bars(spark, sf_dir))))


def _weights(spark, sf_dir) -> DataFrame:
    return pf.capped(pf.inverse_vol(pf.recent_returns(derive_bars(spark, sf_dir)), _names(spark, sf_dir)))


def weights_query(spark, sf_dir) -> DataFrame:
    return rounded(_weights(spark, sf_dir).select("symbol", "weight"))


def selection_query(spark, sf_dir) -> DataFrame:
    bars = held(derive_bars(spark, sf_dir))
    returns = pf.recent_returns(bars)
    chosen = pf.select_names(_scores(spark, sf_dir), lambda names: pf.pair_correlations(returns.where(F.col("symbol").isin(names))), most=5, limit=0.3)
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(chosen)], "place int, symbol string")


def risk_query(spark, sf_dir) -> DataFrame:
    returns = pf.recent_returns(held_bars(spark, sf_dir))
    w = returns.select("symbol").distinct()
    w = w.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy()))
    bench = pf.recent_returns(market(spark, sf_dir))
    return rounded(pf.risk(pf.portfolio_returns(returns, w), bench, w), 4)


def _positions(spark, sf_dir) -> DataFrame:
    """Held shares: the nations' suppliers, bought at a fixed price."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy(F.col("n_name").alias("symbol")).agg(F.count("*").cast("double").alias("shares"), F.lit(1000.0).alias("entry_price"))


def positions_query(spark, sf_dir) -> DataFrame:
    return rounded(cross.positions_value(_positions(spark, sf_dir), derive_bars(spark, sf_dir)), 2)


def rebalance_query(spark, sf_dir) -> DataFrame:
    bars = held_bars(spark, sf_dir)
    target = _names(spark, sf_dir).select("symbol", F.lit(0.1).alias("weight"))
    prices = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    return rounded(pf.rebalance(target, pf.book(_positions(spark, sf_dir), bars), prices, BASE), 3)


def market_query(spark, sf_dir) -> DataFrame:
    return rounded(pf.market_state(market(spark, sf_dir)))


def concentration_query(spark, sf_dir) -> DataFrame:
    held = pf.book(_positions(spark, sf_dir), derive_bars(spark, sf_dir))
    w = held.select("symbol", (F.col("value") / F.sum("value").over(Window.partitionBy())).alias("weight"))
    return rounded(checks.concentration(w).select("status", "value"))


def factor_query(spark, sf_dir) -> DataFrame:
    bars = factors.prepared(derive_bars(spark, sf_dir), *EXPRESSIONS.values())
    for name, text in EXPRESSIONS.items():
        bars = factors.add_factor(bars, text, name)
    return rounded(bars.select("symbol", "date", *EXPRESSIONS), 4)


def build() -> tuple[dict, dict]:
    B, M = sql.BARS, sql.MARKET
    ret = "r AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars), rr AS MATERIALIZED (SELECT * FROM r WHERE ret IS NOT NULL AND date IN (SELECT DISTINCT date FROM r WHERE ret IS NOT NULL ORDER BY date DESC LIMIT 126))"
    last = "lastp AS (SELECT symbol, max_by(close, date) AS price FROM bars GROUP BY symbol)"
    pos = "pos AS (SELECT n_name AS symbol, count(*)::DOUBLE AS shares, 1000.0::DOUBLE AS entry_price FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)"
    names = "nm AS MATERIALIZED (SELECT symbol, 100 * tanh(zscore20) AS score FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1 ORDER BY score DESC, symbol LIMIT 10)"
    run = """q AS (SELECT symbol, CAST(date_trunc('quarter', date) AS DATE) AS quarter, max_by(close, date) AS close FROM bars GROUP BY ALL),
sc AS (SELECT symbol, quarter, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY quarter)) AS score FROM q),
rk AS (SELECT *, count(*) OVER (PARTITION BY quarter) AS n, rank() OVER (PARTITION BY quarter ORDER BY score) AS r, count(*) OVER (PARTITION BY quarter, score) AS ties FROM sc WHERE score IS NOT NULL),
runs AS MATERIALIZED (SELECT CAST(round(date_diff('day', DATE '1970-01-01', quarter) / 91.3125::DOUBLE) AS INT) AS run_id, symbol, score, CASE WHEN n <= 1 THEN 5 ELSE CAST(least(10, greatest(1, floor((100 - 100 * (r + (ties - 1) / 2.0::DOUBLE) / n) / 10) + 1)) AS INT) END AS rank FROM rk)"""
    caps = ", ".join(
        f"e{k} AS (SELECT symbol, c, w, sum(CASE WHEN w > c THEN w - c ELSE 0 END) OVER () AS x, sum(CASE WHEN w < c THEN w ELSE 0 END) OVER () AS u FROM w{k}), w{k + 1} AS (SELECT symbol, c, CASE WHEN x <= 1e-9 THEN w WHEN w > c THEN c WHEN u > 0 THEN w + x * w / u ELSE w END AS w FROM e{k})"
        for k in range(5)
    )
    log = "WITH lg AS (SELECT event_type, value, event_id % 10 <> 3 AS ok, substr(sha256(event_type || '|' || props), 1, 12) AS h FROM events)"
    plan = f"""hb AS (SELECT symbol, max(date) AS last FROM bars GROUP BY symbol), nm AS (SELECT n_name AS symbol, n_nationkey AS k FROM nation UNION ALL SELECT 'NEW', NULL),
pl AS MATERIALIZED (SELECT symbol, plan, CASE WHEN plan = 'recent' THEN CAST(last - INTERVAL {store.OVERLAP_DAYS} DAY AS DATE) END AS start FROM (
  SELECT symbol, last, CASE WHEN last IS NOT NULL AND k % 7 <> 6 AND k * 300 < {store.TTL_SECONDS} THEN 'cache' WHEN last IS NULL OR k % 7 = 6 OR k * 50000 > {store.FULL_SECONDS} THEN 'full' ELSE 'recent' END AS plan FROM nm LEFT JOIN hb USING (symbol)))"""
    queries = {
        "store_point": point_query, "store_upsert": upsert_query, "store_stale": stale_query, "store_universe": universe_query, "runs_kept": runs_kept_query, "runs_previous_ranks": previous_ranks_query, "runs_history": history_query,
        "ledger": ledger_query, "candidates": candidates_query, "store_fetch_plan": _plan, "store_fetched": fetched_query, "store_meta": meta_query, "store_backfill": backfill_query, "runs_saved": saved_query, "runs_latest": latest_run_query, "runs_served": served_query, "fundamental_stored": stored_fundamentals_query,
        "fundamental_medians": medians_query, "pf_correlations": pairs_query, "pf_weights": weights_query, "pf_selection": selection_query, "pf_risk": risk_query, "pf_positions": positions_query, "pf_rebalance": rebalance_query,
        "market_state": market_query, "check_concentration": concentration_query, "factor_values": factor_query,
    }
    z = "(close - avg(close) {0}) / nullif(stddev_samp(close) {0}, 0)".format(sql.over(20))
    oracles = {
        "store_point": f"WITH {B} SELECT * FROM bars WHERE symbol = 'NATION_1'",
        "store_upsert": f"""WITH {B}, fr AS (SELECT symbol, sector, date, open, high, low, high AS close, volume + 1 AS volume FROM bars QUALIFY date_diff('day', date, max(date) OVER (PARTITION BY symbol)) < 7),
nw AS (SELECT * FROM fr UNION ALL SELECT symbol, sector, CAST(date + INTERVAL 7 DAY AS DATE), open, high, low, close, volume FROM fr)
SELECT * FROM nw UNION ALL SELECT * FROM bars b WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.symbol = b.symbol AND nw.date = b.date)""",
        "store_stale": f"WITH {B} SELECT symbol, min(date) AS first_date FROM bars GROUP BY symbol HAVING min(date) >= DATE '{CUTOFF}'",
        "store_universe": f"WITH {B} SELECT symbol, count(*) AS n FROM bars GROUP BY symbol HAVING count(*) >= 600",
        "runs_kept": f"WITH {B}, {run} SELECT run_id, symbol, round(score, 5) AS score, rank FROM runs WHERE run_id IN (SELECT DISTINCT run_id FROM runs ORDER BY run_id DESC LIMIT 50)",
        "runs_previous_ranks": f"WITH {B}, {run} SELECT symbol, max(run_id) AS run_id, max_by(rank, run_id) AS rank FROM runs WHERE run_id < (SELECT max(run_id) FROM runs) GROUP BY symbol",
        "runs_history": f"WITH {B}, {run} SELECT run_id, symbol, round(score, 5) AS score, rank FROM runs QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY run_id DESC) <= 8",
        "ledger": f"{log} SELECT count(*) AS total, greatest(1, count(DISTINCT CASE WHEN ok THEN h END)) AS distinct_trials FROM lg",
        "candidates": f"{log} SELECT CASE WHEN value > 50 THEN 'pass' ELSE 'weak' END AS verdict, event_type AS expression, count(*) AS n FROM lg WHERE ok GROUP BY ALL",
        "store_fetch_plan": f"WITH {B}, {plan} SELECT symbol, plan, start FROM pl",
        "store_fetched": f"WITH {B}, {plan}, lt AS (SELECT symbol, date, close + 1 AS close FROM bars QUALIFY date_diff('day', date, max(date) OVER (PARTITION BY symbol)) <= 20), pu AS MATERIALIZED (SELECT lt.*, plan FROM lt JOIN pl USING (symbol) WHERE plan = 'full' OR (plan = 'recent' AND date >= start)), nw AS (SELECT symbol, date, close FROM pu UNION ALL SELECT symbol, date, close FROM bars b WHERE NOT EXISTS (SELECT 1 FROM pu WHERE pu.symbol = b.symbol AND (pu.plan = 'full' OR pu.date = b.date))) SELECT symbol, count(*) AS n, min(date) AS first_date, round(sum(close), 2) AS total FROM nw GROUP BY symbol",
        "store_meta": f"SELECT kind || ':' || n_name AS key, CAST(CASE WHEN kind = 'fetch' AND n_nationkey % 3 = 0 THEN {NOW} WHEN kind = 'fetch' THEN {NOW} - n_nationkey * 300 ELSE {NOW} - n_nationkey * 50000 END AS VARCHAR) AS value FROM nation, (SELECT unnest(['fetch', 'full']) AS kind) WHERE n_nationkey % 7 <> 6 OR (kind = 'fetch' AND n_nationkey % 3 = 0)",
        "store_backfill": f"WITH {B}, c AS (SELECT symbol, min(date) AS have_from FROM bars WHERE date >= DATE '1993-06-01' OR symbol[-1] > '4' GROUP BY symbol), w AS (SELECT DISTINCT symbol FROM bars UNION SELECT 'MKT') SELECT symbol, have_from FROM w LEFT JOIN c USING (symbol) WHERE have_from IS NULL OR have_from >= CAST(DATE '1999-04-01' - INTERVAL {365 * store.BACKFILL_YEARS} DAY AS DATE)",
        "runs_saved": f"WITH {B}, {run}, l AS (SELECT max(run_id) AS m FROM runs), al AS (SELECT run_id, symbol FROM runs UNION ALL SELECT m + 1, symbol FROM runs, l WHERE run_id = m), n AS (SELECT run_id::BIGINT AS run_id, count(*) AS rows FROM al GROUP BY run_id) SELECT run_id, CASE WHEN run_id IN (SELECT run_id FROM n ORDER BY run_id DESC LIMIT {store.KEPT_RUNS}) THEN rows::INT END AS names, rows FROM n",
        "runs_served": f"WITH {B}, {run} SELECT request, (run_id + 1)::BIGINT AS id, symbol, '1m' AS period, 11 - rank AS rank FROM runs, (VALUES ('both'), ('one')) q(request) WHERE run_id = (SELECT max(run_id) FROM runs) AND (symbol = 'NATION_1' OR symbol = 'NATION_3' AND request = 'both')",
        "runs_latest": f"WITH {B}, {run} SELECT (run_id + 1)::BIGINT AS id, symbol, '1m' AS period, round(-score, 5) AS score, 11 - rank AS rank, CASE WHEN rank = 1 THEN 'STRONG BUY' WHEN rank IN (2, 3) THEN 'BUY' WHEN rank = 4 THEN 'WEAK BUY' WHEN rank = 7 THEN 'WEAK SELL' WHEN rank IN (8, 9) THEN 'SELL' WHEN rank = 10 THEN 'STRONG SELL' ELSE 'HOLD' END AS recommendation FROM runs WHERE run_id = (SELECT max(run_id) FROM runs)",
        "fundamental_stored": f"SELECT n_name AS symbol, CASE WHEN n_name LIKE '%1%' THEN '{{\"pe\":-1}}' ELSE '{{\"pe\":' || n_nationkey || '}}' END AS data, CASE WHEN n_name LIKE '%1%' THEN 0.0::DOUBLE ELSE n_nationkey * 40000.0::DOUBLE END AS age FROM nation WHERE n_name LIKE '%1%' OR n_nationkey * 40000 <= {store.FULL_SECONDS}",
        "fundamental_medians": "WITH p AS (SELECT p_brand, p_retailprice / p_size AS pe FROM part), m AS (SELECT p_brand, quantile_cont(pe, 0.5) AS m FROM p WHERE pe > 0 AND pe < 10000 GROUP BY p_brand) SELECT p_brand, round(any_value(m), 4) AS median_pe, count(*) FILTER (pe > 2 * m) AS rich, count(*) FILTER (pe < 0.5 * m) AS cheap FROM p JOIN m USING (p_brand) GROUP BY p_brand",
        "pf_correlations": f"WITH {B}, {ret} SELECT x.symbol AS a, y.symbol AS b, round(corr(x.ret, y.ret), 5) AS corr FROM rr x JOIN rr y ON x.date = y.date AND x.symbol < y.symbol GROUP BY ALL HAVING count(*) >= 40",
        "pf_weights": sql.with_bars(("zscore20",), "SELECT symbol, round(w / sum(w) OVER (), 5) AS weight FROM w5", more=f"{ret}, {names}, v AS (SELECT symbol, CASE WHEN count(ret) >= 20 AND stddev_samp(ret) > 0 THEN stddev_samp(ret) ELSE 0.02 END AS sd FROM rr GROUP BY symbol), rw AS (SELECT symbol, (1 + greatest(0, score) / 200) / coalesce(sd, 0.02) AS raw FROM nm LEFT JOIN v USING (symbol)), w0 AS (SELECT symbol, greatest(0.15::DOUBLE, 1.0::DOUBLE / count(*) OVER ()) AS c, raw / sum(raw) OVER () AS w FROM rw), {caps}"),
        "pf_selection": sql.with_bars(("zscore20",), "SELECT generate_subscripts(got, 1)::INT AS place, unnest(got) AS symbol FROM (SELECT got FROM pick ORDER BY j DESC LIMIT 1)", True, f"""{ret},
cand AS MATERIALIZED (SELECT symbol, row_number() OVER (ORDER BY s DESC, symbol) AS j FROM (SELECT symbol, 100 * tanh(zscore20) AS s FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) WHERE s > 0),
prs AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.ret, y.ret) AS c FROM rr x JOIN rr y ON x.date = y.date AND x.symbol <> y.symbol GROUP BY ALL HAVING count(*) >= 40),
ord AS MATERIALIZED (SELECT symbol, j, coalesce((SELECT list(b) FROM prs WHERE a = cand.symbol AND c > 0.3), []::VARCHAR[]) AS near FROM cand),
pick AS (SELECT 0::BIGINT AS j, []::VARCHAR[] AS got UNION ALL SELECT o.j, CASE WHEN len(got) < 5 AND NOT list_has_any(near, got) THEN list_append(got, o.symbol) ELSE got END FROM pick JOIN ord o ON o.j = pick.j + 1)"""),
        "pf_risk": f"""WITH {B}, {M}, {ret}, n AS (SELECT count(DISTINCT date) AS d FROM rr), fit AS (SELECT symbol FROM rr GROUP BY symbol HAVING count(*) >= floor((SELECT d FROM n) * 0.6)),
pr AS (SELECT date, sum(ret) / (SELECT count(*) FROM fit) AS ret FROM rr WHERE symbol IN (SELECT symbol FROM fit) GROUP BY date),
mb AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS rb FROM mkt), mr AS (SELECT * FROM mb WHERE rb IS NOT NULL ORDER BY date DESC LIMIT 126), c AS (SELECT quantile_cont(ret, 0.05) AS q FROM pr), h AS (SELECT 1.0::DOUBLE / count(DISTINCT symbol) AS hhi FROM rr)
SELECT round(100 * stddev_samp(ret) * sqrt(252), 4) AS ann_vol, round(100 * (SELECT q FROM c), 4) AS var_95, round(100 * avg(ret) FILTER (ret <= (SELECT q FROM c)), 4) AS cvar_95,
  round((SELECT CASE WHEN count(*) >= 20 THEN covar_samp(ret, rb) / var_pop(rb) END FROM pr JOIN mr USING (date)), 4) AS beta, round((SELECT hhi FROM h), 4) AS hhi, round(1 / (SELECT hhi FROM h), 4) AS effective_positions FROM pr""",
        "pf_positions": f"WITH {B}, {last}, {pos} SELECT symbol, round(shares * price, 2) AS value, round(shares * entry_price, 2) AS cost, round(shares * price - shares * entry_price, 2) AS pnl, round(100 * (shares * price - shares * entry_price) / (shares * entry_price), 2) AS pnl_pct FROM pos JOIN lastp USING (symbol)",
        "pf_rebalance": sql.with_bars(("zscore20",), f"""SELECT symbol, round(price, 3) AS price, round(cv, 3) AS current_value, round(tv, 3) AS target_value, round(tv - cv, 3) AS delta_value, round(CASE WHEN tv = 0 AND shares IS NOT NULL THEN -shares ELSE (tv - cv) / price END, 3) AS delta_shares, CASE WHEN tv > cv THEN 'buy' ELSE 'sell' END AS action
FROM (SELECT coalesce(n.symbol, p.symbol) AS symbol, l.price, p.shares, coalesce(p.shares * l.price, 0) AS cv, CASE WHEN n.symbol IS NULL THEN 0 ELSE 0.1::DOUBLE * {BASE} END AS tv FROM nm n FULL JOIN pos p ON n.symbol = p.symbol LEFT JOIN lastp l ON l.symbol = coalesce(n.symbol, p.symbol)) WHERE abs(tv - cv) >= 0.01 * {BASE}""", more=f"{last}, {pos}, {names}"),
        "market_state": f"""WITH {M}, a AS (SELECT date, close, ln(close / lag(close) OVER (ORDER BY date)) AS r, count(*) OVER w AS n, avg(close) OVER w AS m FROM mkt WINDOW w AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, CASE WHEN count(r) OVER w >= 21 THEN stddev_samp(r) OVER w END AS vol FROM a WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, list(vol) FILTER (vol IS NOT NULL) OVER (ORDER BY date ROWS BETWEEN 1259 PRECEDING AND CURRENT ROW) AS s FROM b),
d AS (SELECT date, CASE WHEN n >= 200 THEN close > m END AS above_200, CASE WHEN n >= 200 THEN 100 * (close / m - 1) END AS dist, CASE WHEN vol IS NOT NULL AND len(s) >= 252 THEN 100.0::DOUBLE * len(list_filter(s, lambda v: v <= vol)) / len(s) END AS p FROM c),
e AS (SELECT *, CASE WHEN above_200 IS NULL AND p IS NULL THEN 'unknown' WHEN above_200 = false AND p >= 80 THEN 'off' WHEN above_200 = false OR p >= 80 THEN 'neutral' ELSE 'on' END AS risk FROM d)
SELECT date, above_200, round(dist, 5) AS dist_200, round(p, 5) AS vol_pctile, risk, CASE risk WHEN 'neutral' THEN 0.6::DOUBLE WHEN 'off' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS exposure, CASE risk WHEN 'neutral' THEN 0.95::DOUBLE WHEN 'off' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM e""",
        "check_concentration": f"WITH {B}, {last}, {pos}, w AS (SELECT shares * price / sum(shares * price) OVER () AS w FROM pos JOIN lastp USING (symbol)) SELECT round(sum(w * w), 5) AS value, CASE WHEN max(w) > 0.15 THEN 'fail' WHEN sum(w * w) > 0.12 THEN 'warn' ELSE 'pass' END AS status FROM w",
        "factor_values": sql.with_bars(("simple_ret", "cmf20"), f"""SELECT symbol, date, round(-z, 4) AS reversal, round(tr - 0.5, 4) AS trend_rank, round(tanh(c5 * 3) + sign(dv), 4) AS squashed_flow, round(least(1, greatest(-1, pc21)) / nullif(sd + 0.01, 0), 4) AS calm_momentum, round(ln(greatest(hi / lo, 1e-9)) - s10, 4) AS range_log
FROM (SELECT *, CASE WHEN n20 >= 20 THEN {z} END AS z, CASE WHEN len(l10) >= 10 THEN len(list_filter(l10, lambda v: v <= close)) / 10.0::DOUBLE END AS tr FROM g)""",
            more=f"""g AS (SELECT *, count(close) {sql.over(20)} AS n20, list(close) {sql.over(10)} AS l10, {sql.roll('avg', 'cmf20', 5)} AS c5, volume - {sql.lag('volume', 5)} AS dv, close / {sql.lag('close', 21)} - 1 AS pc21, {sql.roll('stddev_samp', 'simple_ret', 21)} AS sd, {sql.roll('max', 'high', 10)} AS hi, {sql.roll('min', 'low', 10)} AS lo, {sql.roll('sum', 'simple_ret', 10)} AS s10 FROM f)"""),
    }
    return queries, oracles
