"""Numbers and dates as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentage(x: Column, sign: bool = True) -> Column:
    """Two decimals and a percent sign, with a plus for gains; N/A for null."""
    text = F.format_string("%.2f%%", x)
    plus = F.when(x > 0, "+").otherwise("") if sign else F.lit("")
    return F.when(x.isNull(), "N/A").otherwise(F.concat(plus, text))


def price(x: Column, default: str = "N/A") -> Column:
    """Dollars, with more decimals the smaller the price; whole ones with separators from 1,000 on."""
    small = F.when(x < 0.1, F.format_string("$%.6f", x)).when(x < 1, F.format_string("$%.4f", x)).when(x < 10, F.format_string("$%.3f", x)).when(x < 1000, F.format_string("$%.2f", x))
    return F.when(x.isNull(), default).otherwise(F.coalesce(small, F.concat(F.lit("$"), F.format_number(F.floor(x), 0))))


def number(x: Column) -> Column:
    """The fewest digits that give a double back, without a power of ten from 0.0001 to below 10^16; beyond that with one of two digits or more, as 1.5e+16 and 1e-05."""
    text = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(\.0)?E(?=\d)", "e+"), r"(\.0)?E-", "e-"), r"e([+-])(\d)$", "e$10$2")
    named = F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
    return F.coalesce(named, F.when(~F.contains(text, F.lit("E")), text).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), plain).otherwise(power))


def day(text: Column) -> Column:
    """A timestamp from a day, or a day and time; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
