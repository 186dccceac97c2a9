"""Queries of facts, briefs and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from ..operators import narrate
from ..sources.scratch import held
from .backtest_queries import rounded
from .book_queries import table
from .portfolio_queries import _recommended, last_state


def _facts(spark, sf_dir) -> DataFrame:
    scanned, rec, _, mkt = _recommended(spark, sf_dir)
    book = narrate.book_facts(rec["holdings"], rec["trades"], rec["cash_weight"], rec["added"], rec["dropped"])
    return narrate.scan_facts(scanned).unionByName(book).unionByName(narrate.market_facts(last_state(mkt)))


def facts_query(spark, sf_dir) -> DataFrame:
    return rounded(_facts(spark, sf_dir).drop("list"), 3)


def brief_query(spark, sf_dir) -> DataFrame:
    return narrate.brief(_facts(spark, sf_dir))


def planted_facts(spark, sf_dir) -> DataFrame:
    """Facts of each nation's suppliers: their number, their smallest and largest balance, and each region's as a sleeve."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("array<double>")
    by = s.groupBy("n_nationkey").agg(F.count("*").cast("double").alias("n"), F.round(F.min("s_acctbal"), 2).alias("lo"), F.round(F.max("s_acctbal"), 2).alias("hi"))
    key = F.col("n_nationkey").cast("string")
    parts = by.select(F.concat(F.lit("count."), key).alias("id"), F.col("n").alias("value"), none.alias("list")).unionByName(by.select(F.concat(F.lit("range."), key).alias("id"), F.lit(None).cast("double").alias("value"), F.array("lo", "hi").alias("list")))
    sleeves = s.groupBy("r_regionkey").agg(F.round(F.avg("s_acctbal") / 10_000 - 0.45, 3).alias("value"))
    parts = parts.unionByName(sleeves.select(F.concat(F.lit("sleeve."), F.col("r_regionkey").cast("string")).alias("id"), "value", none.alias("list")))
    return parts.select("id", F.col("id").alias("label"), "value", "list", F.lit(None).cast("string").alias("text"))


#: Sentences about a nation, good and bad, by the remainder of a part's number: text, cited facts, claim.
PLANTED = (
    ("'There are ' || n || ' suppliers.'", ["count"], "data"), ("'There are ' || (n + 1) || ' suppliers.'", ["count"], "data"), ("'Prices fell by 3 elsewhere.'", ["count"], "external"), ("'Nothing is cited, not even ' || n || '.'", [], "data"),
    ("'Unknown is ' || n || '.'", ["count", "nowhere"], "data"), ("'The region is a STRONG tailwind.'", ["sleeve"], "data"), ("'It weighs, and drags.'", ["sleeve", "count"], "data"), ("'Lot A' || n || ' of v1.5 holds ' || n || '-' || n || '.'", ["count"], "data"),
    ("'A minus: -' || n || '.'", ["count"], "data"), ("'The 2 balances are ' || lo || ' and ' || hi || '.'", ["range"], "data"), ("'  '", ["count"], "data"), ("'Some 1,00' || n || ' or 0.5x.'", ["count"], "data"), ("'It is strong and weak.'", ["sleeve"], "data"),
)
KEPT = 1000


def verified_query(spark, sf_dir) -> DataFrame:
    """What is kept of planted sentences, one for each part, and why the rest goes."""
    facts = held(planted_facts(spark, sf_dir))
    named = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    n = facts.where("id LIKE 'count.%'").select(F.split("id", "[.]")[1].cast("int").alias("k"), F.format_string("%.0f", "value").alias("n"), (F.col("value").cast("int")).alias("m"))
    r = facts.where("id LIKE 'range.%'").select(F.split("id", "[.]")[1].cast("int").alias("k"), *[F.format_string("%.2f", F.col("list")[i]).alias(c) for i, c in enumerate(("lo", "hi"))])
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("sid"), (F.col("p_partkey") % 25).cast("int").alias("k"), (F.col("p_partkey") % len(PLANTED)).cast("int").alias("kind"))
    p = p.join(F.broadcast(n.join(r, "k").join(named, F.col("k") == F.col("n_nationkey"))), "k")  # 25 nations
    one = lambda c: F.concat(F.lit(f"{c}."), F.col("n_regionkey" if c == "sleeve" else "k").cast("string")) if c != "nowhere" else F.lit("nowhere")
    text = F.coalesce(*[F.when(F.col("kind") == i, F.expr(t.replace("(n + 1)", "(m + 1)"))) for i, (t, _, _) in enumerate(PLANTED)])
    cited = F.coalesce(*[F.when(F.col("kind") == i, F.array(*map(one, c)) if c else F.array().cast("array<string>")) for i, (_, c, _) in enumerate(PLANTED)])
    claim = F.coalesce(*[F.when(F.col("kind") == i, F.lit(c)) for i, (_, _, c) in enumerate(PLANTED)])
    return narrate.verified(p.select("sid", text.alias("text"), cited.alias("cited"), claim.alias("claim")), facts, KEPT)


def verified_sql() -> str:
    """DuckDB has no lookbehind: a number's left neighbour is matched with it, and a word border stands for the right one."""
    case = lambda values: "CASE kind " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
    one = lambda c: "'nowhere'" if c == "nowhere" else f"'{c}.' || {'rk' if c == 'sleeve' else 'k'}"
    words = lambda w: "[" + ", ".join(f"'{x}'" for x in w) + "]"
    glad, sad = (f"list_has_any(words, {words(w)})" for w in (narrate.POSITIVE, narrate.NEGATIVE))
    return f"""WITH s AS (SELECT n_nationkey AS k, r_regionkey AS rk, s_acctbal AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
b AS MATERIALIZED (SELECT k, any_value(rk) AS rk, count(*)::INT AS m, round(min(b), 2) AS lo, round(max(b), 2) AS hi FROM s GROUP BY k),
f AS MATERIALIZED (SELECT 'count.' || k AS id, [m::DOUBLE] AS allowed, NULL::DOUBLE AS sleeve FROM b UNION ALL SELECT 'range.' || k, [lo, hi, 2.0::DOUBLE], NULL FROM b UNION ALL SELECT 'sleeve.' || rk, [round(avg(b) / 10000 - 0.45, 3)], round(avg(b) / 10000 - 0.45, 3) FROM s GROUP BY rk),
p AS (SELECT p_partkey::INT AS sid, p_partkey % {len(PLANTED)} AS kind, b.k, b.rk, CAST(b.m AS VARCHAR) AS n, b.m, printf('%.2f', b.lo) AS lo, printf('%.2f', b.hi) AS hi FROM part JOIN b ON b.k = p_partkey % 25),
t AS (SELECT sid, trim({case(t.replace("(n + 1)", "(m + 1)") for t, _, _ in PLANTED)}) AS text, {case("[" + ", ".join(map(one, c)) + "]::VARCHAR[]" for _, c, _ in PLANTED)} AS cited, {case(f"'{c}'" for _, _, c in PLANTED)} AS claim FROM p QUALIFY row_number() OVER (ORDER BY sid) <= {2 * KEPT}),
c AS (SELECT sid, count(*) AS n, count(f.id) AS n_known, flatten(list(coalesce(allowed, [])))::DOUBLE[] AS allowed, coalesce(bool_or(sleeve > 1e-6), false) AS up, coalesce(bool_or(sleeve < -1e-6), false) AS down FROM (SELECT sid, unnest(cited) AS id FROM t) u LEFT JOIN f USING (id) GROUP BY sid),
v AS (SELECT t.*, c.n, c.n_known, c.allowed, c.up, c.down, regexp_extract_all(lower(text), '[a-z'']+') AS words, list_transform(regexp_extract_all(text, '(?:^|[^A-Za-z0-9.])(-?[0-9]+(?:,[0-9]{{3}})*(?:[.][0-9]+)?)\\b', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS numbers FROM t LEFT JOIN c USING (sid) WHERE text <> ''),
j AS (SELECT sid, text, CASE WHEN claim = 'external' THEN 'outside knowledge' WHEN n IS NULL THEN 'cites no facts' WHEN n > n_known THEN 'cites unknown facts'
  WHEN len(list_filter(numbers, lambda x: len(list_filter(allowed, lambda a: abs(a - x) <= 0.02 * greatest(abs(a), abs(x), 1e-9))) = 0)) > 0 THEN 'holds other numbers' WHEN (up AND {sad} AND NOT {glad}) OR (down AND {glad} AND NOT {sad}) THEN 'wrong direction' END AS reason FROM v)
SELECT sid, text, CASE WHEN reason IS NOT NULL THEN reason WHEN count(*) FILTER (reason IS NULL) OVER (ORDER BY sid) > {KEPT} THEN 'too many' END AS reason FROM j"""


def formats_query(spark, sf_dir) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice") * 1.000371 / F.pow(F.lit(10.0), F.col("p_partkey") % 7)).alias("x"))
    day = F.format_string("199%d-0%d-1%d", F.col("p_partkey") % 10, F.col("p_partkey") % 9 + 1, F.col("p_partkey") % 9)
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(day, F.lit(" 10:20:30"))).when(F.col("p_partkey") % 3 == 1, day).otherwise("soon")
    return p.select("p_partkey", formats.price(F.col("x")).alias("price"), formats.percentage(F.col("x") - 1).alias("percent"), F.date_format(formats.day(text), "yyyy-MM-dd HH:mm:ss").alias("day"))


def build() -> tuple[dict, dict]:
    queries = {"brief_facts": facts_query, "brief": brief_query, "brief_verified": verified_query, "formats": formats_query}
    oracles = {
        "brief_verified": verified_sql(),
        "formats": """SELECT p_partkey, CASE WHEN x IS NULL THEN 'N/A' WHEN x < 0.1 THEN printf('$%.6f', x) WHEN x < 1 THEN printf('$%.4f', x) WHEN x < 10 THEN printf('$%.3f', x) WHEN x < 1000 THEN printf('$%.2f', x) ELSE '$' || format('{:,}', floor(x)::BIGINT) END AS price,
  CASE WHEN x IS NULL THEN 'N/A' ELSE CASE WHEN x - 1 > 0 THEN '+' ELSE '' END || printf('%.2f%%', x - 1) END AS percent, strftime(coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%Y-%m-%d %H:%M:%S')), '%Y-%m-%d %H:%M:%S') AS day
FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice * 1.000371::DOUBLE / power(10.0::DOUBLE, p_partkey % 7) END AS x, CASE WHEN p_partkey % 3 = 0 THEN d || ' 10:20:30' WHEN p_partkey % 3 = 1 THEN d ELSE 'soon' END AS t
  FROM (SELECT *, printf('199%d-0%d-1%d', p_partkey % 10, p_partkey % 9 + 1, p_partkey % 9) AS d FROM part))""",
    }
    return queries, oracles
