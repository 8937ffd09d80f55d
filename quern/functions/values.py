"""Values as people write them, read by column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How currencies are written. Fixed values.
CURRENCIES = (("US\\$|USD|\\$", "USD"), ("€|EUR", "EUR"), ("£|GBP", "GBP"), ("¥|JPY", "JPY"), ("CHF", "CHF"))
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def cents(said: Column) -> Column:
    """An amount in cents: the last of point and comma, if two digits follow, is the decimal one; brackets or a minus
    before it make it negative. Null if there is no number, or one of more than 16 digits before the decimal ones."""
    digits = F.regexp_extract(said, r"([0-9][0-9 .,']*)", 1)
    decimal = F.regexp_extract(digits, r"[.,]([0-9]{1,2})\s*$", 1)
    whole = F.regexp_replace(F.when(decimal == "", digits).otherwise(F.regexp_replace(digits, r"[.,][0-9]{1,2}\s*$", "")), "[^0-9]", "")
    amount = F.when((whole != "") & (F.length(F.ltrim(whole, F.lit("0"))) <= 16), whole.try_cast("long") * 100 + F.when(decimal == "", 0).otherwise(F.rpad(decimal, 2, "0").cast("long")))
    return F.when(said.rlike(r"\(.*[0-9].*\)|^\s*-|-\s*[$€£]?[0-9]"), -amount).otherwise(amount)


def currency(said: Column) -> Column:
    """The code of the first currency sign in a fixed order of kinds; null if there is none."""
    return F.coalesce(*[F.when(said.rlike(pattern), code) for pattern, code in CURRENCIES])


def _made(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def day(said: Column) -> Column:
    """A date: year first, with dots, or with the month's name; day/month/year only if it can't be month/day/year."""
    part = lambda pattern, i: F.regexp_extract(said, pattern, i)
    iso, dots, slashes = r"^(\d{4})[-/](\d\d)[-/](\d\d)$", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    named, leading = r"^(\d{1,2}) ([A-Za-z]{3,9})\.? (\d{4})$", r"^([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})$"

    def month(name: Column) -> Column:
        short = F.lower(F.substring(name, 1, 3))
        return F.coalesce(*[F.when(short == m[:3], f"{i:02d}") for i, m in enumerate(MONTHS, 1)])

    a, b = part(slashes, 1), part(slashes, 2)
    first, second = a.cast("int"), b.cast("int")
    clear = F.when((first > 12) | (first == second), _made(part(slashes, 3), b, a)).when(second > 12, _made(part(slashes, 3), a, b))
    return (
        F.when(said.rlike(iso), _made(part(iso, 1), part(iso, 2), part(iso, 3))).when(said.rlike(dots), _made(part(dots, 3), part(dots, 2), part(dots, 1)))
        .when(said.rlike(named), _made(part(named, 3), month(part(named, 2)), part(named, 1))).when(said.rlike(leading), _made(part(leading, 3), month(part(leading, 1)), part(leading, 2)))
        .when(said.rlike(slashes), clear)
    )


def entity_name(name: Column) -> Column:
    """A name in lower case without what stands in brackets, quotes, a leading article and repeated blanks."""
    plain = F.regexp_replace(F.lower(name), r"\([^)]*\)|[\"'“”‘’]", "")
    return F.regexp_replace(F.trim(F.regexp_replace(plain, r"\s+", " ")), "^the ", "")


def identifier_parts(name: Column) -> Column:
    """Lower-case parts of a name in snake or camel case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.transform(F.filter(F.split(spaced, " "), lambda x: x != ""), F.lower)


def quote_place(text: Column, quote: Column) -> Column:
    """The place, from 1 on, where a quote first stands; 0 if it does not."""
    return F.call_function("instr", text, quote)


def composed(text: Column) -> Column:
    """Unicode's composed form, without signs that don't show. Texts of plain ASCII are passed through unread."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return F.regexp_replace(normal(text), r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{00AD}]", "")
