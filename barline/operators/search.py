"""The search for factors: proposals are scored together, one job a round; those that pass are judged again on later dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import factors
from ..functions.indicators import add
from ..sources import store
from ..sources.scratch import held
from . import backtest as bt
from .evaluate import expected_max_t
from .score import SLEEVES, Horizon, features, score

#: The last days of the first two windows if none are given, and what the second one asks of |t|.
DISCOVERY_END, VALIDATION_END, VALIDATION_T = "2021-07-29", "2024-05-10", 1.5


def candidates(bars: DataFrame, horizon: Horizon, texts: dict[str, str]) -> DataFrame:
    """(symbol, date, close, n_bar, sleeves, expressions) at every bar: one derivation for all expressions."""
    need = factors.operands(*texts.values()) - factors.RECURSIVE
    table = score(add(features(bars, horizon, more=("n_bar",)), *sorted(need)), horizon)
    for name, text in texts.items():
        table = factors.add_factor(table, text, name)
    return table.select("symbol", "date", "close", "n_bar", *SLEEVES, *texts)


def scored(bars: DataFrame, dates: DataFrame, horizon: Horizon, texts: dict[str, str]) -> DataFrame:
    """The report card of each expression over the dates."""
    return cards(candidates(bars, horizon, texts), dates, list(texts), add(bars, "n_bar"))


def cards(table: DataFrame, dates: DataFrame, names: list[str], plain: DataFrame | None = None) -> DataFrame:
    """The report card of each expression column of :func:`candidates` over the dates; ``plain``: bars that are cheap to derive."""
    plain = table if plain is None else plain
    panel = bt.panel(table, dates, [*SLEEVES, *names], plain)
    cells = dates.agg(F.count("*").alias("d")).join(plain.select("symbol").distinct().agg(F.count("*").alias("s")))  # one row each
    return factors.report(panel, names, SLEEVES, cells.select((F.col("d") * F.col("s")).alias("cells")))


def frozen(mkt: DataFrame, step: int, ends: tuple[str, str]) -> dict[str, DataFrame]:
    """The calendars of the three windows: up to the first end, up to the second, and the rest."""
    return {n: bt.calendar_between(mkt, step, b, e) for n, b, e in (("discovery", None, ends[0]), ("validation", *ends), ("holdout", ends[1], None))}


def review(log: DataFrame, bars: DataFrame, mkt: DataFrame, horizon: Horizon, step: int = 21, ends: tuple[str, str] = (DISCOVERY_END, VALIDATION_END)) -> DataFrame:
    """The survivors of a log of candidates (text lines), judged on all three windows: this opens the holdout, so do it once.

    (expression, discovery_t, validation_t, holdout_ic, holdout_t, holdout_dates, hurdle, clears, holds). A survivor clears if its first t
    beats the hurdle of all expressions that were tried, and holds if the sealed window gives its mean correlation the same
    sign. Lines that a repeated job appended again count once, by their canonical form; broken lines and invalid expressions count for
    nothing. A log without survivors gives no rows. The features are derived and written once, each window reads them.
    """
    spark = bars.sparkSession
    lines = store.lines(log).select("verdict", "expression", F.get_json_object("line", "$.canonical").alias("canonical"))
    tried = lines.agg(F.countDistinct("canonical")).first()[0]
    hurdle = expected_max_t(max(1, tried))
    texts: dict[str, str] = {}
    for row in lines.where("verdict = 'survivor' AND expression IS NOT NULL").select("expression").distinct().orderBy("expression").collect():  # few pass the gate
        try:
            texts.setdefault(factors.canonical(row["expression"]), row["expression"])
        except factors.FactorError:
            continue
    named = {f"e{i}": t for i, t in enumerate(texts.values())}
    if not named:
        return spark.createDataFrame([], "expression string, discovery_t double, validation_t double, holdout_ic double, holdout_t double, holdout_dates long, hurdle double, clears boolean, holds boolean")
    table = held(candidates(bars, horizon, named))
    out = spark.createDataFrame(list(named.items()), "name string, expression string")
    for window, dates in frozen(mkt, step, ends).items():
        got = cards(table, dates, list(named))
        out = out.join(got.select(F.col("expression").alias("name"), F.col("mean_ic").alias(f"{window}_ic"), F.col("t").alias(f"{window}_t"), F.col("n_dates").alias(f"{window}_dates")), "name", "left")
    clears, holds = F.coalesce(F.abs("discovery_t") > hurdle, F.lit(False)), F.coalesce(F.signum("holdout_ic") == F.signum("discovery_ic"), F.lit(False))
    return out.select("expression", "discovery_t", "validation_t", "holdout_ic", "holdout_t", "holdout_dates", F.lit(hurdle).alias("hurdle"), clears.alias("clears"), holds.alias("holds"))


def search(bars: DataFrame, mkt: DataFrame, horizon: Horizon, rounds: int = 1, count: int = 12, step: int = 21, ends: tuple[str, str] = (DISCOVERY_END, VALIDATION_END), history: list[dict] | None = None, proposals: list[str] | None = None, candidate_log: str | None = None, trial_log: str | None = None, open_holdout: bool = False) -> dict:
    """Rounds of proposals (drawn from the language, or given), each distinct one scored once and logged as a trial.

    Windows are frozen: up to the first end, up to the second, and the rest, which stays sealed unless ``open_holdout``. Returns rows
    (a dict for each proposal), survivors, trials and hurdle. The driver sees expressions and their report cards.
    """
    spark = bars.sparkSession
    windows = frozen(mkt, step, ends)
    rows, seen = list(history or []), {r.get("canonical") for r in history or []}
    for turn in range(rounds):
        texts: dict[str, str] = {}
        for text in proposals if proposals is not None else factors.propose_random(count, len(rows) * 1000 + turn):
            try:
                key = factors.canonical(text)
            except factors.FactorError as e:
                rows.append({"expression": text, "verdict": f"invalid: {e}"})
                continue
            if key not in seen:
                seen.add(key)
                texts[f"e{len(texts)}"] = text
        if not texts:
            continue
        table = held(candidates(bars, horizon, texts))
        first = {r["expression"]: r.asDict() for r in cards(table, windows["discovery"], list(texts)).collect()}
        good = {n: t for n, t in texts.items() if first.get(n, {}).get("verdict") == "pass"}
        second = {r["expression"]: r.asDict() for r in cards(table, windows["validation"], list(good)).collect()} if good else {}
        fresh = []
        for name, text in texts.items():
            card = first.get(name)
            row = {"expression": text, "canonical": factors.canonical(text), "discovery": card, "verdict": card["verdict"] if card else "unscored"}
            if name in good:
                t, u = (second.get(name) or {}).get("t"), card["t"]
                row["validation"] = second.get(name)
                row["verdict"] = "survivor" if t is not None and abs(t) >= VALIDATION_T and (t > 0) == (u > 0) else "failed validation"
            fresh.append(row)
        rows += fresh
        if trial_log:
            store.log_lines(spark, [{"hash": store.digest({"job": "search", "expression": r["expression"], "step": step}), "metrics": {"t": (r["discovery"] or {}).get("t")}} for r in fresh], trial_log)
        if candidate_log:
            store.log_lines(spark, fresh, candidate_log)
        if proposals is not None:
            break
    survivors = [r for r in rows if r["verdict"] == "survivor"]
    if open_holdout and survivors:
        texts = {f"e{i}": r["expression"] for i, r in enumerate(survivors)}
        last = {r["expression"]: r.asDict() for r in scored(bars, windows["holdout"], horizon, texts).collect()}
        for i, r in enumerate(survivors):
            r["holdout"] = last.get(f"e{i}")
    trials = max(1, len({r["canonical"] for r in rows if "canonical" in r}))
    return {"rows": rows, "survivors": survivors, "trials": trials, "hurdle": expected_max_t(trials)}
