"""Typed reading of values written by people, entirely in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.keys import strip

#: Words that stand for a missing value.
STAND_INS = ("", "-", "--", "---", "?", "??", "n/a", "na", "n.a.", "#n/a", "null", "none", "nil", "nan", "tbd", "tba",
             "unknown", "not available", "not applicable", "not known", "(blank)", "blank", "xxxx", "xxx", "to be provided",
             "to be confirmed", "to be announced", "undefined", "missing", "pending", ".", "..", "...")

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = ("(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|"
          "oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")  # fmt: skip
_TIME = r"(?:[t ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:z|[+-]\d{2}:?\d{2})?)?"
_DIGITS = r"(?:\d+|\d{1,3}(?:,\d{3})+|\d{1,2}(?:,\d{2})*,\d{3})"
_CURRENCY = r"^(?:inr|rs\.?|₹|usd|us\$|\$|eur|€|gbp|£)\s*|\s*/-$"


def parse_json_object(c: Column) -> Column:
    """A JSON object as map<string,string>; null for null, for other JSON values and for malformed text.

    Wrapped in an array so that text after the object is an error; nested values keep their JSON text.
    """
    wrapped = F.from_json(
        F.concat(F.lit("["), c, F.lit("]")),
        "array<map<string,string>>",
        {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"},
    )
    return F.when(c.rlike(r"^\s*\{") & (F.size(wrapped) == 1), F.try_element_at(wrapped, F.lit(1)))


def says_nothing(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c)).isin(*STAND_INS)


def _number(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), _CURRENCY, ""), _CURRENCY, "")


def to_bigint(c: Column) -> Column:
    """A whole number: plain, grouped in thousands or lakhs, with a currency sign, '/-' or a zero fraction."""
    n = _number(c)
    plain = F.regexp_replace(n, ",", "")
    whole = F.when(n.rlike(rf"^[+-]?{_DIGITS}(?:\.0*)?$"), plain.try_cast("decimal(38,4)"))
    science = F.when(n.rlike(r"^[+-]?\d(?:\.\d+)?e[+]?\d{1,2}$"), plain.try_cast("double").try_cast("decimal(38,4)"))
    d = F.coalesce(whole, science)
    return F.when(d == F.floor(d), d.try_cast("bigint"))


def to_double(c: Column) -> Column:
    """A number, also with a percent sign or the words 'per cent'."""
    n = F.regexp_replace(_number(c), r"\s*(?:%|per\s?cent|pct\.?)$", "")
    return F.when(n.rlike(rf"^[+-]?(?:{_DIGITS}(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?$"), F.regexp_replace(n, ",", "").try_cast("double"))


def to_boolean(c: Column) -> Column:
    v = F.lower(strip(c))
    return F.when(v.isin("true", "yes", "y", "1", "t"), F.lit(True)).when(v.isin("false", "no", "n", "0", "f"), F.lit(False))


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.when(y.rlike("[1-9]"), F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date"))


def to_date(c: Column) -> Column:
    """An existing calendar date: ISO with or without a time, day first (month first where only that exists), or named month."""
    v = F.lower(strip(c))
    iso = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}$"
    dmy = rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}){_TIME}$"
    named = rf"^(\d{{1,2}})(?:st|nd|rd|th)?[- ]+({_MONTH})\.?[-, ]+(\d{{4}})$"
    american = rf"^({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s+(\d{{4}})$"
    x = lambda p, i: F.regexp_extract(v, p, i)
    month = lambda name: F.array_position(F.array(*map(F.lit, _MONTHS)), F.substring(name, 1, 3)).cast("string")
    return (
        F.when(v.rlike(iso), _date(x(iso, 1), x(iso, 2), x(iso, 3)))
        .when(v.rlike(dmy), F.coalesce(_date(x(dmy, 4), x(dmy, 3), x(dmy, 1)), _date(x(dmy, 4), x(dmy, 1), x(dmy, 3))))
        .when(v.rlike(named), _date(x(named, 3), month(x(named, 2)), x(named, 1)))
        .when(v.rlike(american), _date(x(american, 3), month(x(american, 1)), x(american, 2)))
    )


CASTS = {"bigint": to_bigint, "double": to_double, "date": to_date, "boolean": to_boolean, "text": lambda c: c}


def readable(c: Column, value_type: Column) -> Column:
    """Whether the value denotes one of its type; text always does."""
    out = F.lit(True)
    for kind in ("bigint", "double", "date", "boolean"):
        out = F.when(value_type == kind, CASTS[kind](c).isNotNull()).otherwise(out)
    return out
