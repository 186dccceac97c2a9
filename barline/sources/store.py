"""Stored tables as Parquet and JSON: histories with their freshness, runs and their scores, keyed values, fundamentals, logs.

Every change is a DataFrame from the table before it and what comes new; :func:`replaced` writes the result as the table's next
version, and a one-line pointer names the version that counts. So a lost job leaves the last version in place.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import SCHEMA, clean

#: How long a fetched history is fresh, when it is fetched whole again, days that are pulled again, runs that are kept.
TTL_SECONDS, FULL_SECONDS, OVERLAP_DAYS, KEPT_RUNS, HISTORY_LIMIT, BACKFILL_YEARS = 15 * 60, 7 * 24 * 3600, 7, 50, 200, 6
TABLES = {
    "prices": SCHEMA,
    "meta": "key string, value string",
    "runs": "id long, ts double, universe string, results string",
    "score_history": "run_id long, ts double, symbol string, period string, score double, rank int, recommendation string",
    "fundamentals": "symbol string, data string, fetched_at double",
}


def opened(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table's current version; empty with its schema where none is written yet."""
    version = _version(spark, root, name)
    return spark.createDataFrame([], TABLES[name]) if version is None else spark.read.schema(TABLES[name]).parquet(f"{root}/{name}/v{version}")


def _version(spark: SparkSession, root: str, name: str) -> int | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("version long").json(f"{root}/{name}/pointer").agg(F.max("version")).first()[0]
    except AnalysisException:  # nothing written yet
        return None


def replaced(table: DataFrame, root: str, name: str) -> None:
    """Writes the next version, then points at it."""
    spark = table.sparkSession
    version = (_version(spark, root, name) or 0) + 1
    table.write.mode("overwrite").parquet(f"{root}/{name}/v{version}")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{root}/{name}/pointer")


def stored_history(prices: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """New bars replace those of equal symbol and date; with ``replace`` all old bars of the symbols that come new go. Bars without a close are left out."""
    new = clean(new)
    old = prices.join(new.select("symbol").distinct(), "symbol", "left_anti") if replace else prices.join(new.select("symbol", "date"), ["symbol", "date"], "left_anti")
    return old.unionByName(new)


def put(meta: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed values (key, value): new ones replace old ones; of several new ones the greatest counts."""
    return meta.join(new.select("key"), "key", "left_anti").unionByName(new.groupBy("key").agg(F.max("value").alias("value")))


def marked(meta: DataFrame, symbols: DataFrame, now: float, full: bool) -> DataFrame:
    """Notes that the symbols were fetched now, and whole if ``full``."""
    kinds = F.array(*map(F.lit, ("fetch", "full") if full else ("fetch",)))
    return put(meta, symbols.select("symbol", F.explode(kinds).alias("kind")).select(F.concat_ws(":", "kind", "symbol").alias("key"), F.lit(str(now)).alias("value")))


def fetch_plan(prices: DataFrame, meta: DataFrame, symbols: DataFrame, now: float) -> DataFrame:
    """(symbol, plan, start): "cache" while fresh, "full" where nothing is held or the last whole fetch is old, else "recent" from OVERLAP_DAYS before the last bar."""
    held = prices.groupBy("symbol").agg(F.max("date").alias("last"))
    when = lambda kind: meta.where(F.startswith("key", F.lit(f"{kind}:"))).select(F.substring("key", len(kind) + 2, 1000).alias("symbol"), F.col("value").cast("double").alias(kind))
    t = symbols.select("symbol").distinct().join(held, "symbol", "left").join(when("fetch"), "symbol", "left").join(when("full"), "symbol", "left")
    fresh = F.col("last").isNotNull() & (F.lit(now) - F.col("fetch") < TTL_SECONDS)
    whole = F.col("last").isNull() | F.col("full").isNull() | (F.lit(now) - F.col("full") > FULL_SECONDS)
    plan = F.when(fresh, "cache").when(whole, "full").otherwise("recent")
    return t.select("symbol", plan.alias("plan"), F.when(plan == "recent", F.date_sub("last", OVERLAP_DAYS)).alias("start"))


def fetched(prices: DataFrame, plan: DataFrame, pulled: DataFrame) -> DataFrame:
    """The history after ``pulled`` bars have come for the plan: whole ones replace, recent ones are merged; symbols that brought nothing keep what they had."""
    kind = pulled.join(plan.select("symbol", "plan", "start"), "symbol")
    whole = kind.where("plan = 'full'").drop("plan", "start")
    recent = kind.where("plan = 'recent' AND date >= start").drop("plan", "start")
    return stored_history(stored_history(prices, whole, replace=True), recent)


def backfill_plan(prices: DataFrame, symbols: DataFrame, now: str, extra: tuple[str, ...] = ("MKT",), force: bool = False) -> DataFrame:
    """(symbol, have_from) of those to fetch whole: not held, or held from less than BACKFILL_YEARS ago only."""
    wanted = symbols.select("symbol").unionByName(prices.sparkSession.createDataFrame([(e,) for e in extra], "symbol string")).distinct()
    first = prices.groupBy("symbol").agg(F.min("date").alias("have_from"))
    t = wanted.join(first, "symbol", "left")
    return t if force else t.where(F.col("have_from").isNull() | (F.col("have_from") >= F.date_sub(F.to_date(F.lit(now)), 365 * BACKFILL_YEARS)))


def saved_run(runs: DataFrame, history: DataFrame, scan: DataFrame, ts: float) -> tuple[DataFrame, DataFrame]:
    """Runs and score history with one run more: its scan as a JSON document, its scores one row each; only the newest KEPT_RUNS runs stay.

    A run is one document by contract, as large as its universe; the score history is the table to query.
    """
    next_id = runs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    row = F.struct("symbol", "period", "score", "rank", "recommendation")
    document = scan.agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("universe"), F.to_json(F.array_sort(F.collect_list(row))).alias("results"))
    run = document.join(next_id).select("id", F.lit(float(ts)).alias("ts"), "universe", "results")  # one row each
    scores = scan.where(F.col("score").isNotNull()).join(F.broadcast(next_id)).select(F.col("id").alias("run_id"), F.lit(float(ts)).alias("ts"), "symbol", "period", "score", F.col("rank").cast("int").alias("rank"), "recommendation")
    both = runs.unionByName(run)
    keep = both.select("id").orderBy(F.desc("id")).limit(KEPT_RUNS)
    return both.join(keep, "id", "left_semi"), history.unionByName(scores)


RECOMMENDED = "last_recommendation"


def remembered(meta: DataFrame, names: list[str], ts: float) -> DataFrame:
    """The keyed values with the names of a recommendation, for the next one to start from."""
    value = json.dumps({"symbols": sorted(names), "ts": ts})
    return put(meta, meta.sparkSession.createDataFrame([(RECOMMENDED, value)], TABLES["meta"]))


def last_recommended(meta: DataFrame) -> DataFrame:
    """(symbol, ts) of the names recommended last, one row each; none before the first time or where the value is broken."""
    value = F.from_json("value", "symbols array<string>, ts double")
    t = meta.where(F.col("key") == RECOMMENDED).select(value.alias("v"))
    return t.select(F.explode("v.symbols").alias("symbol"), F.col("v.ts").alias("ts")).where("symbol IS NOT NULL").distinct()


RUN_ROW = "array<struct<symbol string, period string, score double, rank int, recommendation string>>"


def latest_run(runs: DataFrame, now: float | None = None, max_age: float | None = None) -> DataFrame:
    """(id, ts, symbol, period, score, rank, recommendation) of the newest run; nothing if it is older than ``max_age`` seconds."""
    top = runs.orderBy(F.desc("id")).limit(1)
    if max_age is not None:
        top = top.where(F.lit(now) - F.col("ts") <= max_age)
    return top.select("id", "ts", F.inline(F.from_json("results", RUN_ROW)))


def served(runs: DataFrame, symbols: list[str], periods: list[str], now: float, max_age: float) -> DataFrame:
    """:func:`latest_run` of the asked symbols, if that run can answer: it is no older than ``max_age`` seconds, its universe has all of them, and each period was scored for some name. Else nothing, and a scan is due."""
    parsed = F.from_json("results", RUN_ROW)
    lacks = F.array_except(F.array(*map(F.lit, symbols)), F.split("universe", ","))
    seen = F.transform(parsed, lambda r: r["period"])
    can = [F.lit(now) - F.col("ts") <= max_age, F.size(lacks) == 0, *[F.array_contains(seen, p) for p in periods]]
    top = runs.orderBy(F.desc("id")).limit(1)
    for c in can:
        top = top.where(c)
    return top.select("id", "ts", F.inline(parsed)).where(F.col("symbol").isin(symbols))


def run_before(history: DataFrame, before: int | None = None) -> DataFrame:
    """(symbol, period, rank) of the newest run, or of the newest one before ``before``."""
    h = history if before is None else history.where(F.col("run_id") < before)
    last = h.agg(F.max("run_id").alias("last"))
    return h.join(F.broadcast(last), F.col("run_id") == F.col("last")).where("rank IS NOT NULL").select("symbol", "period", "rank")  # one row


def history_of(history: DataFrame, symbol: str, period: str = "1m", limit: int = HISTORY_LIMIT) -> DataFrame:
    """(ts, score, rank, recommendation), oldest first, of the last ``limit`` runs."""
    return history.where((F.col("symbol") == symbol) & (F.col("period") == period)).orderBy(F.desc("ts")).limit(limit).select("ts", "score", "rank", "recommendation").orderBy("ts")


def saved_fundamentals(table: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """``new`` (symbol, data: JSON) replaces what was stored for its symbols."""
    return table.join(new.select("symbol"), "symbol", "left_anti").unionByName(new.select("symbol", "data", F.lit(float(now)).alias("fetched_at")))


def fundamentals_of(table: DataFrame, now: float, max_age: float = FULL_SECONDS) -> DataFrame:
    """(symbol, data, age) of what is not older than ``max_age`` seconds."""
    age = F.lit(float(now)) - F.col("fetched_at")
    return table.where(F.col("data").isNotNull() & (age <= max_age)).select("symbol", "data", age.alias("age"))


def digest(config: dict) -> str:
    """Twelve characters that name a configuration, whatever the order of its keys."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]


def log_lines(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Appends rows to a folder of JSON lines; what a driver logs is a few rows a round."""
    spark.createDataFrame([(json.dumps(r, default=str),) for r in rows], "value string").coalesce(1).write.mode("append").text(path)


def log_trial(spark: SparkSession, config: dict, metrics: dict, path: str) -> str:
    log_lines(spark, [{"hash": digest(config), "config": config, "metrics": metrics}], path)
    return digest(config)


def lines(log: DataFrame) -> DataFrame:
    """(line, hash, verdict, expression) of a log read as text; empty lines go, broken ones have nulls."""
    t = log.where(F.trim("value") != "")
    return t.select(F.col("value").alias("line"), F.get_json_object("value", "$.hash").alias("hash"), F.get_json_object("value", "$.verdict").alias("verdict"), F.get_json_object("value", "$.expression").alias("expression"))


def trials(log: DataFrame) -> DataFrame:
    """One row (total, distinct_trials): every line counts, broken ones too; distinct ones by their hash; one at least."""
    return log.agg(F.count("*").alias("total"), F.greatest(F.lit(1), F.countDistinct("hash")).cast("long").alias("distinct_trials"))


def sound(log: DataFrame) -> DataFrame:
    """The lines that are JSON objects."""
    return log.where(F.try_parse_json("line").isNotNull() & F.startswith(F.trim("line"), F.lit("{")))


def summary_json(stats: DataFrame, path: str) -> None:
    """The statistics of a backtest as JSON lines, one for each strategy, without its curves."""
    stats.drop("log_equity", "equity").coalesce(1).write.mode("overwrite").json(path)


#: Settings of a scan and what they are if a file doesn't say.
DEFAULTS = {"symbols": [], "periods": ["1d", "1w", "1m", "6m", "1y"], "refresh_seconds": 1800, "only_buys": True, "ranks_above": 7, "most": 20}


def load_config(spark: SparkSession, path: str) -> dict:
    """Settings from a JSON file over the defaults; the defaults alone where the file is missing or broken."""
    from pyspark.errors import AnalysisException

    try:
        found = json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    except (AnalysisException, ValueError):
        return dict(DEFAULTS)
    return DEFAULTS | {k: v for k, v in found.items() if k in DEFAULTS} if isinstance(found, dict) else dict(DEFAULTS)


def save_config(spark: SparkSession, config: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(DEFAULTS | config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
