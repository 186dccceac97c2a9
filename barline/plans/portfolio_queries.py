"""Queries of the recommended book, its risk, its checks and fundamentals, from a whole scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, fundamental
from ..operators import portfolio as pf
from ..operators.score import HORIZONS, SLEEVES, scan
from ..sources import store
from ..sources.bars import held_bars, held_market, market
from ..sources.scratch import held
from . import indicator_sql as sql
from .backtest_queries import rounded
from .book_queries import _positions, table
from .score_queries import score_ctes

MOST, LIMIT, CLUSTER, PREVIOUS, BASE = 6, 0.3, 0.25, ("NATION_1", "NATION_2"), 50_000.0
USED = ("1d", "1w", "1m")


def fundamentals(spark, sf_dir, day: DataFrame) -> DataFrame:
    """Figures of a symbol, from its suppliers; the next report is some days after the benchmark's last date, one row (today)."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    got = s.groupBy(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"), "n_nationkey").agg((F.sum("s_acctbal") / 1000).alias("trailing_pe"), (F.avg("s_acctbal") / 900).alias("price_to_book"), (F.max("s_acctbal") / 25000).alias("roe"))
    got = got.join(F.broadcast(day))  # one row
    return got.select(
        "symbol", "sector", "trailing_pe", (F.col("trailing_pe") * 0.9).alias("forward_pe"), "price_to_book", "roe", (F.col("roe") / 2).alias("margin"), (F.col("roe") / 9).alias("dividend_yield"),
        F.date_add("today", (F.col("n_nationkey") * 3 - 4).cast("int")).alias("next_earnings"), ((F.col("n_nationkey") * 79190) % 1_300_000).cast("double").alias("age"),
    )


def today(mkt: DataFrame) -> DataFrame:
    return mkt.agg(F.max("date").alias("today"))


def last_state(mkt: DataFrame) -> DataFrame:
    """The market's last state, one row."""
    return pf.market_state(mkt).orderBy(F.desc("date")).limit(1)


def _recommended(spark, sf_dir, previous: tuple[str, ...] = PREVIOUS) -> tuple[DataFrame, dict, DataFrame, DataFrame]:
    """The scan, the book that it recommends, and the bars and the benchmark that both come from, each written once."""
    bars, mkt = held_bars(spark, sf_dir), held_market(spark, sf_dir)
    scanned = held(scan(bars, *USED))
    exposure = last_state(mkt).first()["exposure"]
    return scanned, pf.recommend(scanned, bars, _positions(spark, sf_dir), exposure, previous, BASE, MOST, LIMIT), bars, mkt


def recommend_query(spark, sf_dir) -> DataFrame:
    return rounded(_recommended(spark, sf_dir)[1]["holdings"], 4)


def trades_query(spark, sf_dir) -> DataFrame:
    return rounded(_recommended(spark, sf_dir)[1]["trades"], 3)


def changes_query(spark, sf_dir) -> DataFrame:
    rec = _recommended(spark, sf_dir)[1]
    return spark.createDataFrame([(rec["exposure"], rec["cash_weight"], rec["base"], ",".join(rec["added"]), ",".join(rec["dropped"]))], "exposure double, cash_weight double, base double, added string, dropped string")


def carried_query(spark, sf_dir) -> DataFrame:
    """What became of each name: the book of the last scan is read from the store, the new one starts from it and takes its place."""
    symbols = table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol"))
    meta = store.marked(spark.createDataFrame([], store.TABLES["meta"]), symbols, 1000.0, full=False)
    meta = held(store.remembered(meta, list(PREVIOUS), 2000.0))
    before = store.last_recommended(meta)
    previous = tuple(sorted(r["symbol"] for r in before.select("symbol").collect()))  # a book has few names
    rec = _recommended(spark, sf_dir, previous)[1]
    chosen = [r["symbol"] for r in rec["weights"].select("symbol").collect()]
    after = store.last_recommended(store.remembered(meta, chosen, 3000.0))
    both = before.withColumnRenamed("ts", "seen").join(after, "symbol", "full")
    became = F.when(F.col("seen").isNull(), "added").when(F.col("ts").isNull(), "dropped").otherwise("kept")
    return both.select("symbol", became.alias("became"), "seen", F.col("ts").alias("now"))


def risk_query(spark, sf_dir) -> DataFrame:
    return rounded(pf.portfolio_risk(_positions(spark, sf_dir), held_bars(spark, sf_dir), market(spark, sf_dir)), 4)


def run_checks(spark, sf_dir) -> tuple[DataFrame, dict]:
    scanned, rec, bars, mkt = _recommended(spark, sf_dir)
    weights, returns, day = rec["weights"], pf.recent_returns(bars), today(mkt)
    parts = [
        checks.concentration(weights), checks.correlated(returns, weights, CLUSTER), checks.earnings(weights, fundamentals(spark, sf_dir, day), day), checks.regime_mix(weights, scanned),
        checks.turnover(rec["trades"], rec["base"] * rec["exposure"]), checks.exposure(last_state(mkt)), checks.separation(scanned.where("period = '1m'").select("symbol", "score"), weights),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, rec


def checks_query(spark, sf_dir) -> DataFrame:
    return rounded(run_checks(spark, sf_dir)[0].select("id", "status", "value"), 4)


def review_query(spark, sf_dir) -> DataFrame:
    return checks.review(run_checks(spark, sf_dir)[0]).select("blocking", "n_fail", "n_warn", "summary", F.array_join(F.transform("concerns", lambda c: F.concat_ws(":", c["id"], c["severity"])), ",").alias("concerns"))


def clusters_query(spark, sf_dir) -> DataFrame:
    """Groups among all names, by a bar that the noise of these prices reaches."""
    return checks.clusters(pf.recent_returns(held_bars(spark, sf_dir)), corr=CLUSTER)


def summary_query(spark, sf_dir) -> DataFrame:
    day = held(today(market(spark, sf_dir)))
    f = fundamentals(spark, sf_dir, day)
    got = fundamental.summary(f, fundamental.medians(f), day)
    return got.withColumn("flags", F.array_join("flags", "; "))


def medians_query(spark, sf_dir) -> DataFrame:
    return rounded(fundamental.medians(fundamentals(spark, sf_dir, today(market(spark, sf_dir))), "sector"), 2)


def refresh_query(spark, sf_dir) -> DataFrame:
    ages = fundamentals(spark, sf_dir, today(market(spark, sf_dir))).select("symbol", F.when(F.col("symbol") != "NATION_3", F.col("age")).alias("age"))
    return fundamental.to_refresh(ages)


def build() -> tuple[dict, dict]:
    B, M = sql.BARS, sql.MARKET
    names = tuple(dict.fromkeys(n for p in USED for n in HORIZONS[p].needs()))
    ret = "r AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars), rr AS MATERIALIZED (SELECT * FROM r WHERE ret IS NOT NULL AND date IN (SELECT DISTINCT date FROM r WHERE ret IS NOT NULL ORDER BY date DESC LIMIT 126))"
    last = "lastp AS (SELECT symbol, max_by(close, date) AS price FROM bars GROUP BY symbol)"
    pos = "pos AS (SELECT n_name AS symbol, count(*)::DOUBLE AS shares FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)"
    state = """ma AS (SELECT date, close, ln(close / lag(close) OVER (ORDER BY date)) AS r, count(*) OVER w AS n, avg(close) OVER w AS m FROM mkt WINDOW w AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
mb AS (SELECT *, CASE WHEN count(r) OVER w >= 21 THEN stddev_samp(r) OVER w END AS vol FROM ma WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
mc AS (SELECT *, list(vol) FILTER (vol IS NOT NULL) OVER (ORDER BY date ROWS BETWEEN 1259 PRECEDING AND CURRENT ROW) AS s FROM mb),
md AS (SELECT date, CASE WHEN n >= 200 THEN close > m END AS above, CASE WHEN vol IS NOT NULL AND len(s) >= 252 THEN 100.0::DOUBLE * len(list_filter(s, lambda v: v <= vol)) / len(s) END AS p FROM mc),
gate AS MATERIALIZED (SELECT CASE WHEN above IS NULL AND p IS NULL THEN 1.0::DOUBLE WHEN above = false AND p >= 80 THEN 0.3::DOUBLE WHEN above = false OR p >= 80 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS exposure FROM md ORDER BY date DESC LIMIT 1)"""
    caps = ", ".join(
        f"e{k} AS (SELECT symbol, c, w, sum(CASE WHEN w > c THEN w - c ELSE 0 END) OVER () AS x, sum(CASE WHEN w < c THEN w ELSE 0 END) OVER () AS u FROM w{k}), w{k + 1} AS (SELECT symbol, c, CASE WHEN x <= 1e-9 THEN w WHEN w > c THEN c WHEN u > 0 THEN w + x * w / u ELSE w END AS w FROM e{k})"
        for k in range(5)
    )
    prior = ", ".join(f"'{s}'" for s in PREVIOUS)
    # Names kept from before come first while they rank well, then all by score; each only if no chosen one is close to it.
    chosen = f"""cand AS MATERIALIZED (SELECT symbol, score, row_number() OVER (ORDER BY score DESC, symbol) AS i FROM s_1m WHERE score > 0),
prs AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.ret, y.ret) AS c FROM rr x JOIN rr y ON x.date = y.date AND x.symbol <> y.symbol GROUP BY ALL HAVING count(*) >= 40),
ord AS MATERIALIZED (SELECT symbol, near, row_number() OVER (ORDER BY turn, i) AS j FROM (
  SELECT symbol, i, coalesce((SELECT list(b) FROM prs WHERE a = cand.symbol AND c > {LIMIT}), []::VARCHAR[]) AS near, unnest(CASE WHEN symbol IN ({prior}) AND i <= {int(MOST * pf.KEEP)} THEN [1, 2] ELSE [2] END) AS turn FROM cand)),
pick AS (SELECT 0::BIGINT AS j, []::VARCHAR[] AS got UNION ALL SELECT o.j, CASE WHEN len(got) < {MOST} AND NOT list_contains(got, o.symbol) AND NOT list_has_any(near, got) THEN list_append(got, o.symbol) ELSE got END FROM pick JOIN ord o ON o.j = pick.j + 1),
nm AS MATERIALIZED (SELECT symbol, score FROM cand WHERE list_contains((SELECT got FROM pick ORDER BY j DESC LIMIT 1), symbol)),
v AS (SELECT symbol, CASE WHEN count(ret) >= 20 AND stddev_samp(ret) > 0 THEN stddev_samp(ret) ELSE 0.02 END AS sd FROM rr GROUP BY symbol), rw AS (SELECT symbol, (1 + greatest(0, score) / 200) / coalesce(sd, 0.02) AS raw FROM nm LEFT JOIN v USING (symbol)),
w0 AS (SELECT symbol, greatest(0.15::DOUBLE, 1.0::DOUBLE / count(*) OVER ()) AS c, raw / sum(raw) OVER () AS w FROM rw), {caps}, wt AS MATERIALIZED (SELECT symbol, w / sum(w) OVER () AS weight FROM w5)"""
    scored = ["last_bars AS MATERIALIZED (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)", *(score_ctes(HORIZONS[p], "last_bars", f"s_{p}") for p in USED)]
    trades = f"""tb AS MATERIALIZED (SELECT {BASE} * exposure AS base FROM gate),
tr AS MATERIALIZED (SELECT * FROM (SELECT coalesce(w.symbol, p.symbol) AS symbol, l.price, p.shares, coalesce(p.shares * l.price, 0) AS cv, coalesce(w.weight, 0) * (SELECT base FROM tb) AS tv
  FROM wt w FULL JOIN pos p ON w.symbol = p.symbol LEFT JOIN lastp l ON l.symbol = coalesce(w.symbol, p.symbol)) WHERE abs(tv - cv) >= greatest(0.01 * (SELECT base FROM tb), 25))"""
    fund = """td AS MATERIALIZED (SELECT max(date) AS today FROM mkt),
fu AS MATERIALIZED (SELECT *, trailing_pe * 0.9 AS forward_pe, roe / 2 AS margin, roe / 9 AS dividend_yield, CAST(today + to_days(CAST(k * 3 - 4 AS INT)) AS DATE) AS next_earnings, CAST((k * 79190) % 1300000 AS DOUBLE) AS age FROM (
  SELECT n_name AS symbol, r_name AS sector, n_nationkey AS k, sum(s_acctbal) / 1000 AS trailing_pe, avg(s_acctbal) / 900 AS price_to_book, max(s_acctbal) / 25000 AS roe FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL), td)"""
    reach = f"""rd AS (SELECT * FROM rr WHERE date IN (SELECT DISTINCT date FROM rr ORDER BY date DESC LIMIT {checks.CLUSTER_DATES})), sn AS (SELECT symbol FROM rd GROUP BY symbol HAVING count(*) >= {checks.CLUSTER_LEAST}),
cp AS MATERIALIZED (SELECT x.symbol AS a, y.symbol AS b FROM rd x JOIN rd y ON x.date = y.date AND x.symbol <> y.symbol WHERE x.symbol IN (FROM sn) AND y.symbol IN (FROM sn) GROUP BY ALL HAVING count(*) >= 2 AND corr(x.ret, y.ret) > {CLUSTER}),"""
    groups = "gr AS (SELECT a AS symbol, a AS o FROM cp UNION SELECT gr.symbol, cp.b FROM gr JOIN cp ON cp.a = gr.o), hd AS MATERIALIZED (SELECT symbol, min(o) AS head FROM gr GROUP BY symbol)"
    held_reach = reach.replace("FROM rr WHERE date", "FROM rr WHERE symbol IN (SELECT symbol FROM wt) AND date")
    med = "md2 AS (SELECT quantile_cont(trailing_pe, 0.5) AS m FROM fu WHERE trailing_pe > 0 AND trailing_pe < 10000)"
    all_checks = f"""ck AS MATERIALIZED (
SELECT 'concentration' AS id, CASE WHEN max(weight) > 0.15 + 1e-6 THEN 'fail' WHEN sum(weight * weight) > {checks.HHI_WARN} THEN 'warn' ELSE 'pass' END AS status, sum(weight * weight) AS value FROM wt
UNION ALL SELECT 'correlation_clusters', CASE WHEN coalesce(max(n), 0) >= {checks.CLUSTER_NAMES} THEN 'warn' ELSE 'pass' END, coalesce(max_by(w, (n, -pos)) FILTER (n >= {checks.CLUSTER_NAMES}), 0) * 100 FROM (SELECT head, count(*) AS n, sum(weight) AS w, row_number() OVER (ORDER BY head) AS pos FROM hd JOIN wt USING (symbol) GROUP BY head)
UNION ALL SELECT 'earnings_proximity', CASE WHEN coalesce(sum(weight) * 100, 0) > {checks.EARNINGS_WARN} THEN 'warn' ELSE 'pass' END, coalesce(sum(weight) * 100, 0) FROM wt JOIN fu USING (symbol) WHERE date_diff('day', today, next_earnings) BETWEEN 0 AND {checks.EARNINGS_SESSIONS * checks.CALENDAR_DAYS}
UNION ALL SELECT 'regime_mix', 'pass', max(n) FROM (SELECT trend_state, count(*) AS n FROM wt LEFT JOIN s_1m USING (symbol) GROUP BY trend_state)
UNION ALL SELECT 'turnover_cost', CASE WHEN sum(abs(tv - cv)) / (SELECT base FROM tb) > {checks.TURNOVER_WARN} THEN 'warn' ELSE 'pass' END, coalesce(sum(abs(tv - cv)), 0) / (SELECT base FROM tb) FROM tr
UNION ALL SELECT 'exposure', CASE WHEN exposure < 1 THEN 'warn' ELSE 'pass' END, exposure FROM gate
UNION ALL SELECT 'score_separation', CASE WHEN n < {checks.SEPARATION_NAMES} THEN 'skip' WHEN g < {checks.SEPARATION_WARN} THEN 'warn' ELSE 'pass' END, CASE WHEN n >= {checks.SEPARATION_NAMES} THEN g END FROM (
  SELECT count(*) AS n, coalesce((avg(score) FILTER (symbol IN (SELECT symbol FROM wt)) - avg(score) FILTER (symbol NOT IN (SELECT symbol FROM wt))) / nullif(stddev_pop(score), 0), 0) AS g FROM s_1m))"""

    def query(select: str, *more: str) -> str:
        return sql.with_bars(names, select, True, ",\n".join((M, ret, last, pos, state, *scored, chosen, *more)))

    whole = (trades, fund, held_reach + groups, all_checks)
    timing = "CASE WHEN s >= 15 THEN 'enter' WHEN s <= -15 THEN 'wait' ELSE 'ok' END"
    facts = f"""ms AS MATERIALIZED (SELECT date, CASE WHEN n >= 200 THEN close > m END AS above, CASE WHEN n >= 200 THEN 100 * (close / m - 1) END AS dist, CASE WHEN vol IS NOT NULL AND len(s) >= 252 THEN 100.0::DOUBLE * len(list_filter(s, lambda v: v <= vol)) / len(s) END AS p FROM mc ORDER BY date DESC LIMIT 1),
ch AS MATERIALIZED (SELECT (SELECT coalesce(list(symbol ORDER BY symbol), []) FROM nm WHERE symbol NOT IN ({prior})) AS added, (SELECT coalesce(list(s ORDER BY s), []) FROM (SELECT unnest([{prior}]) AS s) WHERE s NOT IN (SELECT symbol FROM nm)) AS dropped),
bh AS MATERIALIZED (SELECT symbol, weight, score FROM wt JOIN nm USING (symbol) ORDER BY weight DESC, symbol LIMIT 8),
fc0(id, label, value, text) AS (
  {" UNION ALL ".join(f"SELECT 'sleeve.{s}', 'mean {s.replace('_', ' ')}', round(avg({s}), 3), NULL::VARCHAR FROM s_1m" for s in SLEEVES)}
  UNION ALL SELECT 'regime.' || trend_state, 'names that are ' || trend_state, count(*)::DOUBLE, NULL FROM s_1m GROUP BY trend_state
  UNION ALL SELECT 'count.' || recommendation, 'names that are ' || recommendation, count(*)::DOUBLE, NULL FROM s_1m GROUP BY recommendation
  UNION ALL (SELECT 'name.' || symbol, symbol, round(score, 1), recommendation FROM s_1m ORDER BY score DESC, symbol LIMIT 8)
  UNION ALL SELECT 'portfolio.n_names', 'number of names held', count(*)::DOUBLE, NULL FROM wt
  UNION ALL SELECT 'portfolio.cash_pct', 'percent held in cash', 100 * (1 - exposure), NULL FROM gate
  UNION ALL SELECT 'portfolio.added', 'names added', len(added)::DOUBLE, coalesce(nullif(array_to_string(added, ', '), ''), 'nothing') FROM ch
  UNION ALL SELECT 'portfolio.dropped', 'names dropped', len(dropped)::DOUBLE, coalesce(nullif(array_to_string(dropped, ', '), ''), 'nothing') FROM ch
  UNION ALL SELECT 'rebalance.n_trades', 'number of trades', count(*)::DOUBLE, NULL FROM tr
  UNION ALL SELECT 'rebalance.net_cash', 'cash that the trades need', round(coalesce(sum(tv - cv), 0), 2), NULL FROM tr
  UNION ALL SELECT 'holding.' || symbol || '.weight', symbol || ' weight', round(100 * weight, 1), NULL FROM bh
  UNION ALL SELECT 'holding.' || symbol || '.score', symbol || ' score', round(score, 1), NULL FROM bh
  UNION ALL SELECT 'market.risk', 'market state', NULL, CASE WHEN above IS NULL AND p IS NULL THEN 'unknown' WHEN above = false AND p >= 80 THEN 'off' WHEN above = false OR p >= 80 THEN 'neutral' ELSE 'on' END FROM ms
  UNION ALL SELECT 'market.exposure', 'invested share', round(exposure, 2), NULL FROM gate
  UNION ALL SELECT 'market.dist_200', 'percent over the mean of 200 bars', round(dist, 2), NULL FROM ms WHERE dist IS NOT NULL
  UNION ALL SELECT 'market.vol_pctile', 'percentile of volatility', round(p, 2), NULL FROM ms WHERE p IS NOT NULL),
fc AS MATERIALIZED (SELECT * FROM fc0)"""
    of = lambda i, c="value": f"(SELECT {c} FROM fc WHERE id = '{i}')"
    worded = lambda c: f"replace(substr({c}, 8), '_', ' ')"
    changes = " || ', ' || ".join((of("portfolio.added", "text"), of("portfolio.dropped", "text")))
    told = f"""sl AS (SELECT arg_max(id, (value, id)) AS hi, max(value) AS hv, arg_min(id, (value, id)) AS lo, min(value) AS lv FROM fc WHERE starts_with(id, 'sleeve.')),
st AS (SELECT 0 AS i, 'The market is ' || {of("market.risk", "text")} || '.' AS text, [] AS allowed
  UNION ALL SELECT 1, CASE WHEN {of("portfolio.cash_pct")} > 0 THEN printf('The book holds %.0f names and %.1f percent cash.', {of("portfolio.n_names")}, {of("portfolio.cash_pct")}) ELSE printf('The book holds %.0f names.', {of("portfolio.n_names")}) END, [{of("portfolio.n_names")}, {of("portfolio.cash_pct")}]
  UNION ALL SELECT 2, CASE WHEN {changes} <> 'nothing, nothing' THEN 'New: ' || {of("portfolio.added", "text")} || '; gone: ' || {of("portfolio.dropped", "text")} || '.' ELSE 'The names are the same as before.' END, [{of("portfolio.added")}, {of("portfolio.dropped")}]
  UNION ALL SELECT 3, printf('The %s sleeve reads %.3f, the %s sleeve %.3f.', {worded("hi")}, hv, {worded("lo")}, lv), [hv, lv] FROM sl),
nu AS (SELECT i, text, allowed, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9.])(-?[0-9]+(?:,[0-9]{{3}})*(?:[.][0-9]+)?)\\b', 1)) AS x FROM st),
wr AS (SELECT DISTINCT i FROM nu WHERE len(list_filter(allowed, lambda a: abs(a - CAST(replace(x, ',', '') AS DOUBLE)) <= 0.02 * greatest(abs(a), abs(CAST(replace(x, ',', '') AS DOUBLE)), 1e-9))) = 0),
jd AS MATERIALIZED (SELECT st.*, i IN (SELECT i FROM wr) AS wrong FROM st)"""
    queries = {
        "pf_recommend": recommend_query, "pf_recommend_trades": trades_query, "pf_changes": changes_query, "pf_carried": carried_query, "pf_portfolio_risk": risk_query, "check_all": checks_query, "check_review": review_query, "check_clusters": clusters_query,
        "fundamental_summary": summary_query, "fundamental_sectors": medians_query, "fundamental_refresh": refresh_query,
    }
    oracles = {
        "pf_recommend": query(f"SELECT symbol, round(weight, 4) AS weight, round(score, 4) AS score, {timing} AS timing, round(price, 4) AS price, round(weight * {BASE} * exposure, 4) AS target_value, round(weight * {BASE} * exposure / price, 4) AS target_shares FROM (SELECT wt.*, nm.score, price, exposure, coalesce(d.score, e.score) AS s FROM wt JOIN nm USING (symbol) JOIN lastp USING (symbol) LEFT JOIN s_1d d ON d.symbol = wt.symbol LEFT JOIN s_1w e ON e.symbol = wt.symbol, gate)"),
        "pf_recommend_trades": query("SELECT symbol, round(price, 3) AS price, round(cv, 3) AS current_value, round(tv, 3) AS target_value, round(tv - cv, 3) AS delta_value, round(CASE WHEN tv = 0 AND shares IS NOT NULL THEN -shares ELSE (tv - cv) / price END, 3) AS delta_shares, CASE WHEN tv > cv THEN 'buy' ELSE 'sell' END AS action FROM tr", trades),
        "pf_changes": query(f"SELECT exposure, 100 * (1 - exposure) AS cash_weight, {BASE}::DOUBLE AS base, (SELECT coalesce(string_agg(symbol, ',' ORDER BY symbol), '') FROM nm WHERE symbol NOT IN ({prior})) AS added, (SELECT coalesce(string_agg(s, ',' ORDER BY s), '') FROM (SELECT unnest([{prior}]) AS s) WHERE s NOT IN (SELECT symbol FROM nm)) AS dropped FROM gate"),
        "pf_carried": query(f"SELECT coalesce(a.s, nm.symbol) AS symbol, CASE WHEN a.s IS NULL THEN 'added' WHEN nm.symbol IS NULL THEN 'dropped' ELSE 'kept' END AS became, CASE WHEN a.s IS NOT NULL THEN 2000.0::DOUBLE END AS seen, CASE WHEN nm.symbol IS NOT NULL THEN 3000.0::DOUBLE END AS now FROM (SELECT unnest([{prior}]) AS s) a FULL JOIN nm ON a.s = nm.symbol"),
        "pf_portfolio_risk": f"""WITH {B}, {M}, {ret}, {last}, {pos}, w AS MATERIALIZED (SELECT symbol, shares * price / sum(shares * price) OVER () AS weight FROM pos JOIN lastp USING (symbol)), n AS (SELECT count(DISTINCT date) AS d FROM rr), fit AS MATERIALIZED (SELECT symbol FROM rr GROUP BY symbol HAVING count(*) >= floor((SELECT d FROM n) * 0.6)),
uw AS (SELECT symbol, weight / sum(weight) OVER () AS u FROM w WHERE symbol IN (FROM fit)), pr AS MATERIALIZED (SELECT date, sum(ret * u) AS ret FROM rr JOIN uw USING (symbol) GROUP BY date), mb AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS rb FROM mkt), mr AS (SELECT * FROM mb WHERE rb IS NOT NULL ORDER BY date DESC LIMIT 126),
c AS (SELECT quantile_cont(ret, 0.05) AS q FROM pr), h AS (SELECT sum(weight * weight) AS hhi FROM w),
hd AS MATERIALIZED (SELECT * FROM rr WHERE symbol IN (FROM fit)), ps AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.ret, y.ret) AS corr FROM hd x JOIN hd y ON x.date = y.date AND x.symbol < y.symbol GROUP BY ALL HAVING count(*) >= 2),
tq AS (SELECT avg(corr) AS avg_corr, max_by(a, corr) AS pair_a, max_by(b, corr) AS pair_b, max(corr) AS pair_corr FROM ps WHERE corr IS NOT NULL)
SELECT round(100 * stddev_samp(ret) * sqrt(252), 4) AS ann_vol, round(100 * (SELECT q FROM c), 4) AS var_95, round(100 * avg(ret) FILTER (ret <= (SELECT q FROM c)), 4) AS cvar_95, round((SELECT CASE WHEN count(*) >= 20 THEN covar_samp(ret, rb) / var_pop(rb) END FROM pr JOIN mr USING (date)), 4) AS beta,
  round((SELECT hhi FROM h), 4) AS hhi, round(1 / (SELECT hhi FROM h), 4) AS effective_positions, (SELECT max_by(symbol, weight) FROM w) AS top_symbol, round((SELECT max(weight) FROM w), 4) AS top_weight, round(any_value(avg_corr), 4) AS avg_corr, any_value(pair_a) AS pair_a, any_value(pair_b) AS pair_b, round(any_value(pair_corr), 4) AS pair_corr FROM pr, tq""",
        "check_all": query("SELECT id, status, round(value, 4) AS value FROM ck", *whole),
        "check_review": query("""SELECT n_fail > 0 AS blocking, n_fail, n_warn, CASE WHEN n_fail > 0 THEN n_fail || ' failed: ' || f WHEN n_warn > 0 THEN 'none failed, ' || n_warn || ' to look at: ' || w ELSE 'all ' || n || ' passed' END AS summary, concerns FROM (
SELECT count(*) AS n, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'warn') AS n_warn, string_agg(id, '; ' ORDER BY id) FILTER (status = 'fail') AS f, string_agg(id, '; ' ORDER BY id) FILTER (status = 'warn') AS w,
  coalesce(string_agg(id || CASE WHEN status = 'fail' THEN ':high' ELSE ':medium' END, ',' ORDER BY status, id) FILTER (status IN ('fail', 'warn')), '') AS concerns FROM ck)""", *whole),
        "brief_facts": query("SELECT id, label, round(value, 3) AS value, text FROM fc", trades, facts),
        "brief": query("SELECT string_agg(text, ' ' ORDER BY i) FILTER (NOT wrong) AS text, count(*) FILTER (NOT wrong) AS n_kept, count(*) FILTER (wrong) AS n_rejected, count(*) FILTER (wrong) / count(*)::DOUBLE AS rejected_share, (SELECT count(*) FROM fc) AS n_facts, (SELECT substr(sha256(string_agg(l, chr(10) ORDER BY l)), 1, 12) FROM (SELECT id || '|' || coalesce(CAST(value AS VARCHAR), text, '') AS l FROM fc)) AS facts_hash FROM jd", trades, facts, told),
        "check_clusters": f"WITH RECURSIVE {B}, {ret}, {reach} {groups} SELECT symbol, head, (count(*) OVER (PARTITION BY head))::INT AS size FROM hd",
        "fundamental_summary": f"""WITH {M}, {fund}, {med} SELECT symbol, sector, round(trailing_pe, 2) AS pe, round(forward_pe, 2) AS forward_pe, round(price_to_book, 2) AS pb, round(roe * 100, 2) AS roe, round(margin * 100, 2) AS margin, round(dividend_yield * 100, 2) AS dividend_yield, next_earnings,
  array_to_string(list_filter([CASE WHEN d BETWEEN 0 AND 7 THEN printf('reports in %d days', d) END, CASE WHEN trailing_pe > 0 AND trailing_pe > 2 * m THEN printf('dear: %.0f times earnings, median %.0f', trailing_pe, m) WHEN trailing_pe > 0 AND trailing_pe < 0.5 * m THEN printf('cheap: %.0f times earnings, median %.0f', trailing_pe, m) END,
    CASE WHEN roe > 0.30 THEN printf('return on equity %.0f%%', 100 * roe) END], lambda t: t IS NOT NULL), '; ') AS flags FROM (SELECT *, date_diff('day', today, next_earnings) AS d FROM fu, md2)""",
        "fundamental_sectors": f"WITH {M}, {fund} SELECT sector, " + ", ".join(f"round(quantile_cont(CASE WHEN {m} > 0 AND {m} < 10000 THEN {m} END, 0.5), 2) AS median_{m}" for m in fundamental.MEASURES) + " FROM fu GROUP BY sector",
        "fundamental_refresh": f"WITH {M}, {fund} SELECT symbol, age FROM (SELECT symbol, CASE WHEN symbol <> 'NATION_3' THEN age END AS age FROM fu) WHERE age IS NULL OR age >= {fundamental.WEEK} ORDER BY age DESC NULLS FIRST, symbol LIMIT 8",
    }
    return queries, oracles
