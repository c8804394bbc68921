"""Money, percentages and durations in text, as built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.spans import matches

NUMBER = r"\d+(?:,\d{2,3})*(?:\.\d+)?"
# Money is a currency and a number with or without a unit, or a number and a unit other than a bare M.
MONEY = (
    r"(?iuU)(?:(?:₹|\$|USD|INR|EUR|GBP|£|€)\s*" + NUMBER + r"\s*(?:Cr|Crore|Crores|L|Lakh|Lakhs|M|Million|Millions|B|Billion|Billions|K|Thousand|Thousands)?\b"
    r"|" + NUMBER + r"\s*(?:Cr|Crores?|Lakhs?|Millions?|Billions?|Thousands?|[LBK])\b)"
)
# Unit multipliers and currency codes (written forms are case-sensitive).
MULTIPLIERS = {
    "cr": 10_000_000, "crore": 10_000_000, "crores": 10_000_000,
    "l": 100_000, "lakh": 100_000, "lakhs": 100_000,
    "k": 1_000, "thousand": 1_000, "thousands": 1_000,
    "m": 1_000_000, "million": 1_000_000, "millions": 1_000_000,
    "b": 1_000_000_000, "billion": 1_000_000_000, "billions": 1_000_000_000,
}
CURRENCIES = {"₹": "INR", "INR": "INR", "$": "USD", "USD": "USD", "EUR": "EUR", "€": "EUR", "GBP": "GBP", "£": "GBP"}
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
DURATION = r"(?iuU)(\d+)\s*(month|months|year|years)"

AMOUNT = "decimal(20,4)"


def _lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def amount_of(match: Column) -> Column:
    """Number times unit of the text of one money match."""
    number = F.regexp_replace(F.regexp_extract(match, NUMBER, 0), ",", "").cast(AMOUNT)
    unit = F.lower(F.regexp_extract(match, r"\d(?U)\s*([A-Za-z]+)\s*$", 1))
    return (number * F.coalesce(_lookup(unit, MULTIPLIERS), F.lit(1)).cast("decimal(10,0)")).cast(AMOUNT)


def currency_of(match: Column) -> Column:
    return F.coalesce(_lookup(F.regexp_extract(match, r"^(₹|\$|[A-Za-z]{3}|£|€)", 1), CURRENCIES), F.lit(""))


def money_occurrences(text: Column) -> Column:
    """array<struct<text, start, end, amount, currency>>, in order."""
    return F.transform(matches(text, MONEY), lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), amount_of(m["text"]).alias("amount"), currency_of(m["text"]).alias("currency")))


def first_money(text: Column) -> Column:
    """struct<amount, currency> of the first money in the text, null if none."""
    found = F.regexp_extract(text, MONEY, 0)
    return F.when(found != "", F.struct(amount_of(found).alias("amount"), currency_of(found).alias("currency")))


def percentage(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, PERCENT, 1), F.lit("")).cast(AMOUNT)


def duration_months(text: Column) -> Column:
    """Months of the first duration anywhere in the text."""
    n = F.nullif(F.regexp_extract(text, DURATION, 1), F.lit("")).cast("int")
    return F.when(F.lower(F.regexp_extract(text, DURATION, 2)).startswith("year"), n * 12).otherwise(n)
