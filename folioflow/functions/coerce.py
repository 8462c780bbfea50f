"""Coercion of messy text to types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: date layouts in the order in which they are tried
DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "d MMMM yyyy", "MMMM d, yyyy"]
_NUMBER = r"^-?(\d+\.?\d*|\.\d+)$"


def _number(x: Column) -> Column:
    return F.when(x.rlike(_NUMBER), x.try_cast("double"))


def coerce_int(x: Column) -> Column:
    """H8: from the digits and - alone."""
    return F.regexp_replace(x, r"[^0-9\-]", "").try_cast("long")


def coerce_float(x: Column) -> Column:
    """H9: from the digits, - and . alone."""
    return _number(F.regexp_replace(x, r"[^0-9\-.]", ""))


def coerce_bool(x: Column) -> Column:
    """H10."""
    low = F.lower(F.trim(x))
    return F.when(low.isin("true", "yes", "1", "y", "on"), True).when(low.isin("false", "no", "0", "n", "off"), False)


def coerce_date(x: Column) -> Column:
    """By the first layout that fits; day before month."""
    return F.coalesce(*[F.try_to_date(F.trim(x), f) for f in DATE_FORMATS])


def coerce_currency(x: Column) -> Column:
    """Amount and raw text; codes go before symbols."""
    left = F.regexp_replace(x, r"ZAR|USD|EUR|GBP", "")
    return F.struct(_number(F.regexp_replace(left, r"[R$€£,\s]", "")).alias("amount"), x.alias("raw"))


def coerce(value: Column, kind: Column) -> Column:
    """JSON of the value as the type (its text where unknown), success and error."""
    text = {
        "integer": coerce_int(value).cast("string"),
        "float": coerce_float(value).cast("string"),
        "boolean": coerce_bool(value).cast("string"),
        "date": coerce_date(value).cast("string"),
        "currency": coerce_currency(value)["amount"].cast("string"),
    }
    out = None
    for name, x in text.items():
        out = F.when(kind == name, x) if out is None else out.when(kind == name, x)
    out = out.otherwise(value)
    return F.struct(out.alias("coerced"), out.isNotNull().alias("success"), F.when(out.isNull(), F.concat(F.lit("cannot coerce to "), kind)).alias("error"))
