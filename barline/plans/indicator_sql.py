"""The indicators in DuckDB SQL, written from their definitions. Each name has its needs and an expression over bars."""

from __future__ import annotations

BARS = """bars AS MATERIALIZED (
  SELECT n_name AS symbol, r_name AS sector, CAST(l_shipdate AS DATE) AS date,
    min_by(l_extendedprice / l_quantity, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey}) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    max_by(l_extendedprice / l_quantity, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey}) AS close,
    sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""

MARKET = """mkt AS MATERIALIZED (
  SELECT 'MKT' AS symbol, NULL AS sector, CAST(l_shipdate AS DATE) AS date,
    min_by(l_extendedprice / l_quantity, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey}) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    max_by(l_extendedprice / l_quantity, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey}) AS close,
    sum(l_quantity) AS volume
  FROM lineitem GROUP BY CAST(l_shipdate AS DATE))"""

BY = "PARTITION BY symbol ORDER BY date"


def over(k: int) -> str:
    return f"OVER ({BY} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, k: int, least: int | None = None) -> str:
    """``x`` may hold two columns for a regression."""
    both = " + ".join(p.strip() for p in x.split(","))
    return f"CASE WHEN count({both}) {over(k)} >= {k if least is None else least} THEN {f}({x}) {over(k)} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({BY})"


SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "n_bar": ((), f"row_number() OVER ({BY})"),
    "lc": ((), "ln(close)"),
    "pc": ((), lag("close")),
    "d": (("pc",), "close - pc"),
    "tp": ((), "(high + low + close) / 3"),
    "log_ret": (("pc",), "ln(close / pc)"),
    "simple_ret": (("pc",), "close / pc - 1"),
    "true_range": (("pc",), "CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END"),
    "rv21": (("log_ret",), f"({roll('stddev_samp', 'log_ret', 21)}) * sqrt(252.0) * 100"),
    "hl2": ((), "power(ln(high / low), 2)"),
    "parkinson21": (("hl2",), f"sqrt(({roll('avg', 'hl2', 21)}) / (4 * ln(2.0)) * 252) * 100"),
    "gkt": ((), "0.5 * power(ln(high / low), 2) - (2 * ln(2.0) - 1) * power(ln(close / open), 2)"),
    "gka": (("gkt",), roll("avg", "gkt", 21)),
    "garman_klass21": (("gka",), "CASE WHEN gka IS NOT NULL THEN sqrt(greatest(gka, 0) * 252) * 100 END"),
    "rvs": (("rv21",), f"list(rv21) FILTER (rv21 IS NOT NULL) {over(252)}"),
    "vol_pctile": (("rvs",), "CASE WHEN rv21 IS NOT NULL AND len(rvs) >= 21 THEN 100.0 * len(list_filter(rvs, lambda v: v <= rv21)) / len(rvs) END"),
    "mom_12_1": ((), f"{lag('close', 21)} / {lag('close', 252)} - 1"),
    "ad": (("d",), "abs(d)"),
    "dist_52": ((), f"100 * (close / ({roll('max', 'close', 252, 20)}) - 1)"),
    "mg": ((), f"avg(close) {over(10)} - avg(close) {over(50)}"),
    "ma_crossover": (("mg",), f"coalesce(mg / nullif(max(abs(mg)) {over(50)}, 0), 0)"),
    "g": (("d",), "CASE WHEN d > 0 THEN d ELSE 0 END"),
    "l": (("d",), "CASE WHEN d < 0 THEN -d ELSE 0 END"),
    "bbp20": ((), f"coalesce((close - (({roll('avg', 'close', 20)}) - 2 * ({roll('stddev_samp', 'close', 20)}))) / nullif(4 * ({roll('stddev_samp', 'close', 20)}), 0), 0.5)"),
    "stoch_k": ((), f"coalesce(100 * (close - min(low) {over(14)}) / nullif(max(high) {over(14)} - min(low) {over(14)}, 0), 50)"),
    "stoch_d": (("stoch_k",), f"avg(stoch_k) {over(3)}"),
    "up": ((), f"high - {lag('high')}"),
    "dn": ((), f"low - {lag('low')}"),
    "pdm": (("up", "dn"), "CASE WHEN up > 0 AND up > abs(dn) THEN up ELSE 0 END"),
    "mdm": (("up", "dn"), "CASE WHEN dn < 0 AND abs(dn) > up THEN -dn ELSE 0 END"),
    "pdi": (("pdm", "true_range"), f"100 * avg(pdm) {over(14)} / nullif(avg(true_range) {over(14)}, 0)"),
    "mdi": (("mdm", "true_range"), f"100 * avg(mdm) {over(14)} / nullif(avg(true_range) {over(14)}, 0)"),
    "dx": (("pdi", "mdi"), "100 * abs(pdi - mdi) / nullif(pdi + mdi, 0)"),
    "adx14": (("dx",), f"coalesce(avg(dx) {over(14)}, 25)"),
    "pl": (("lc",), lag("lc")),
    "ar": (("pl", "log_ret"), f"CASE WHEN count(log_ret) {over(125)} >= 29 THEN regr_slope(log_ret, pl) {over(125)} END"),
    "half_life126": (("ar",), "CASE WHEN ar < 0 AND -ln(2.0) / ar < 1260 THEN -ln(2.0) / ar END"),
    "q5": (("log_ret",), roll("sum", "log_ret", 5)),
    "variance_ratio": (("q5",), f"CASE WHEN count(log_ret) {over(252)} >= 50 THEN var_samp(q5) {over(248)} / nullif(5 * var_samp(log_ret) {over(252)}, 0) END"),
    "tpd": (("tp",), f"tp - {lag('tp')}"),
    "fu": (("tpd",), "CASE WHEN tpd > 0 THEN tp * volume ELSE 0 END"),
    "fd": (("tpd",), "CASE WHEN tpd < 0 THEN tp * volume ELSE 0 END"),
    "fu14": (("fu",), roll("sum", "fu", 14)),
    "fd14": (("fd",), roll("sum", "fd", 14)),
    "mfi14": (("fu14", "fd14"), "coalesce(100 - 100 / (1 + fu14 / nullif(fd14, 0)), 50)"),
    "mfv": ((), "((close - low) - (high - close)) / nullif(high - low, 0) * volume"),
    "cmf20": (("mfv",), f"coalesce(({roll('sum', 'mfv', 20)}) / nullif(({roll('sum', 'volume', 20)}), 0), 0)"),
    "sv": (("d",), "coalesce(sign(d), 0) * volume"),
    "obv": (("sv",), f"sum(sv) OVER ({BY} ROWS UNBOUNDED PRECEDING)"),
    "od": (("obv",), f"obv - {lag('obv')}"),
    "obv_z": (("od",), f"(obv - {lag('obv', 20)}) / nullif(({roll('stddev_samp', 'od', 60, 20)}) * sqrt(20.0), 0)"),
    "obv_scaled": (("obv",), f"coalesce(100 * (obv - min(obv) {over(20)}) / nullif(max(obv) {over(20)} - min(obv) {over(20)}, 0), 50)"),
    "tpv": (("tp",), "tp * volume"),
    "vwap20": (("tpv",), f"({roll('sum', 'tpv', 20)}) / nullif(({roll('sum', 'volume', 20)}), 0)"),
    "vwap_dev": (("vwap20",), "100 * (close / vwap20 - 1)"),
    "rel_vol": ((), f"volume / nullif(({roll('avg', 'volume', 20)}), 0)"),
    "hi20": ((), roll("max", "high", 20)),
    "lo20": ((), roll("min", "low", 20)),
    "don_pos": (("hi20", "lo20"), "CASE WHEN hi20 > lo20 THEN least(1, greatest(-1, (close - (hi20 + lo20) / 2) / ((hi20 - lo20) / 2))) END"),
    "ph": ((), f"CASE WHEN count(high) OVER ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 20 THEN max(high) OVER ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END"),
    "plo": ((), f"CASE WHEN count(low) OVER ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 20 THEN min(low) OVER ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END"),
    "don_break": (("ph", "plo"), "CASE WHEN close > ph THEN 1 WHEN close < plo THEN -1 ELSE 0 END"),
    "bb_up": ((), f"({roll('avg', 'close', 20)}) + 2 * ({roll('stddev_samp', 'close', 20)})"),
    "bb_low": ((), f"({roll('avg', 'close', 20)}) - 2 * ({roll('stddev_samp', 'close', 20)})"),
    "sortino252": (("simple_ret",), f"CASE WHEN count(simple_ret) {over(252)} >= 20 THEN avg(simple_ret) {over(252)} / nullif(sqrt(avg(CASE WHEN simple_ret < 0 THEN simple_ret * simple_ret END) {over(252)}), 0) * sqrt(252.0) END"),
    "frame252": ((), f"list(close) {over(252)}"),
    "calmar252": (("max_drawdown252", "frame252"), "CASE WHEN len(frame252) >= 20 THEN (power(close / frame252[1], 252.0 / len(frame252)) - 1) * 100 / nullif(abs(max_drawdown252), 0) END"),
}
for k in (3, 5, 21, 63, 126, 252):
    SQL[f"mom{k}"] = ((), f"close / {lag('close', k)} - 1")
    SQL[f"mom_tstat{k}"] = (("log_ret",), f"({roll('avg', 'log_ret', k)}) / nullif(({roll('stddev_samp', 'log_ret', k)}), 0) * sqrt({k}.0)")
for k in (10, 20, 50):
    SQL[f"er{k}"] = (("ad",), f"CASE WHEN count(ad) {over(k)} >= {k} THEN least(1, abs(close - {lag('close', k)}) / nullif(sum(ad) {over(k)}, 0)) END")
for k in (10, 21, 63, 126, 252):
    SQL[f"linreg_slope{k}"] = (("lc", "n_bar"), f"(exp(252 * ({roll('regr_slope', 'lc, n_bar', k, max(10, k // 3))})) - 1) * 100")
    SQL[f"rsq{k}"] = (("lc", "n_bar"), roll("regr_r2", "lc, n_bar", k, max(10, k // 3)))
    SQL[f"linreg_r2_{k}"] = ((f"rsq{k}",), f"CASE WHEN rsq{k} IS NOT NULL THEN greatest(0, least(1, rsq{k})) END")
for k in (3, 5, 10, 20, 50, 100, 200):
    SQL[f"sma{k}"] = ((), roll("avg", "close", k))
    SQL[f"sma_slow{k}"] = ((), roll("avg", "close", k, max(10, k // 2)))
for k in (3, 7, 14):
    SQL[f"rsi{k}"] = (("g", "l"), f"100 - 100 / (1 + coalesce(avg(g) {over(k)} / nullif(avg(l) {over(k)}, 0), 0))")
for k in (5, 10, 20, 50, 100):
    SQL[f"zscore{k}"] = ((), f"(close - ({roll('avg', 'close', k)})) / nullif(({roll('stddev_samp', 'close', k)}), 0)")
for k in range(2, 21):
    SQL[f"x{k}"] = (("lc",), f"lc - {lag('lc', k)}")
for w in (252, 504):
    SQL[f"tau{w}"] = (tuple(f"x{k}" for k in range(2, 21)), "[" + ", ".join(f"ln(nullif(stddev_pop(x{k}) {over(w - k)}, 0))" for k in range(2, 21)) + "]")
    SQL[f"hurst{w}"] = ((f"tau{w}", "n_bar"), f"CASE WHEN n_bar >= 60 AND len(list_filter(tau{w}, lambda v: v IS NULL)) = 0 THEN least(1, greatest(0, (SELECT regr_slope(t, ln(i + 1)) FROM (SELECT unnest(tau{w}) AS t, generate_subscripts(tau{w}, 1) AS i)))) END")
for k in (21, 63, 126, 252):
    SQL[f"sharpe{k}"] = (("simple_ret",), f"CASE WHEN count(simple_ret) {over(k)} >= 20 THEN avg(simple_ret) {over(k)} / nullif(stddev_pop(simple_ret) {over(k)}, 0) * sqrt(252.0) END")
    SQL[f"fr{k}"] = ((), f"list(close) {over(k)}")
    SQL[f"max_drawdown{k}"] = ((f"fr{k}",), f"CASE WHEN len(fr{k}) >= 5 THEN 100 * list_reduce(list_prepend({{'p': 0.0::DOUBLE, 'w': 0.0::DOUBLE}}, list_transform(fr{k}, lambda c: {{'p': c, 'w': 0.0::DOUBLE}})), lambda a, b: {{'p': greatest(a.p, b.p), 'w': least(a.w, b.p / greatest(a.p, b.p) - 1)}}).w END")

#: Recursive columns: row by row along each symbol's bars.
RECURSIVE = f"""num AS MATERIALIZED (
  SELECT *, row_number() OVER ({BY}) AS rn, lag(close) OVER ({BY}) AS p,
    CASE WHEN row_number() OVER ({BY}) > 10 THEN least(1, abs(close - lag(close, 10) OVER ({BY})) / nullif(sum(step) OVER ({BY} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0)) END AS er
  FROM (SELECT *, abs(close - lag(close) OVER ({BY})) AS step FROM bars)
), rec AS (
  SELECT symbol, date, rn, high - low AS a14, high - low AS a10, close AS e20, close AS e12, close AS e26, 0.0::DOUBLE AS sig, close AS kama FROM num WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.date, n.rn, r.a14 + (greatest(high - low, abs(high - p), abs(low - p)) - r.a14) / 14, r.a10 + (greatest(high - low, abs(high - p), abs(low - p)) - r.a10) / 10,
    r.e20 + (close - r.e20) * 2 / 21, r.e12 + (close - r.e12) * 2 / 13, r.e26 + (close - r.e26) * 2 / 27,
    r.sig + (((r.e12 + (close - r.e12) * 2 / 13) - (r.e26 + (close - r.e26) * 2 / 27)) - r.sig) * 2 / 10,
    r.kama + power(coalesce(er, 0) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) * (close - r.kama)
  FROM rec r JOIN num n ON n.symbol = r.symbol AND n.rn = r.rn + 1
), recursive_bars AS MATERIALIZED (
  SELECT b.*, CASE WHEN rn >= 14 THEN a14 END AS atr14, CASE WHEN rn >= 10 THEN a10 END AS atr10, e20 AS ema20, (e12 - e26) - sig AS macd_hist, kama AS kama10
  FROM bars b JOIN rec USING (symbol, date))"""


def levels(names: tuple[str, ...], source: str = "bars", out: str = "f") -> str:
    """CTEs that add the names to ``source``; the last one is called ``out``."""
    depth: dict[str, int] = {}

    def at(name: str) -> int:
        if name not in SQL:
            return 0
        if name not in depth:
            depth[name] = 1 + max((at(n) for n in SQL[name][0]), default=0)
        return depth[name]

    top = max((at(n) for n in names), default=0)
    ctes, before = [], source
    for k in range(1, top + 1):
        cols = ", ".join(f"{SQL[n][1]} AS {n}" for n, d in depth.items() if d == k)
        name = out if k == top else f"{out}{k}"
        ctes.append(f"{name} AS (SELECT *, {cols} FROM {before})")
        before = name
    return ",\n".join(ctes) if ctes else f"{out} AS (SELECT * FROM {source})"


def with_bars(names: tuple[str, ...], select: str, recursive: bool = False, more: str = "") -> str:
    """A whole query: bars, the indicators as ``f``, any further CTEs, and the select."""
    head = f"WITH RECURSIVE {BARS}" + (f",\n{RECURSIVE}" if recursive else "")
    return f"{head},\n{levels(names, 'recursive_bars' if recursive else 'bars')}{',' + chr(10) + more if more else ''}\n{select}"
