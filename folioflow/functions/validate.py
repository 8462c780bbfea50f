"""Validation rules as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: patterns by name
PATTERNS = {
    "za_id_number": r"^\d{13}$",
    "za_company_reg": r"^\d{4}/\d{6}/\d{2}$",
    "email_rfc5322": r"^[\w\.\+\-]+@[\w\-]+\.[\w\-\.]+$",
    "phone_international": r"^\+[1-9]\d{1,14}$",
    "iban": r"^[A-Z]{2}\d{2}[A-Z0-9]{4,30}$",
    "swift_bic": r"^[A-Z]{6}[A-Z2-9][A-NP-Z0-9]([A-Z0-9]{3})?$",
    "url_https": r"^https://[^\s/$.?#].[^\s]*$",
    "ipv4": r"^(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)$",
    "date_iso": r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])$",
    "postal_code_za": r"^\d{4}$",
}
# fixed values: what results say of a value that fails, by rule
MESSAGES = {
    "required": "Value is required",
    "regex": "Does not match pattern: {0}",
    "min_length": "Minimum length {0}, got ",
    "max_length": "Maximum length {0}, got ",
    "min": "Value below minimum {0}",
    "max": "Value above maximum {0}",
    "number": "Not a number",
    "enum": "Value not in {0}",
    "enum_ci": "Must be one of: {0}",
    "email": "Invalid email address",
    "phone_e164": "Invalid E.164 phone number",
    "iban_format": "Invalid IBAN format",
    "iban_checksum": "IBAN checksum failed",
    "date_format": "Date does not match format {0}",
    "luhn": "Invalid ID number",
}


class Verdict(NamedTuple):
    """What a rule says of a column: whether a value passes, the message where it doesn't, and a passing value's clean form."""

    ok: Column
    error: Column
    clean: Column | None = None


class Given(NamedTuple):
    """A rule's pattern and parameters."""

    pattern: str
    options: dict


_RULES: dict[str, Callable[[Column, Given], Verdict]] = {}


def regex_valid(x: Column, pattern: str, search: bool = False) -> Column:
    """Whether the text fits from its start (anywhere with search); a wrong pattern is an error at once."""
    re.compile(pattern)
    return x.rlike(pattern if search else f"^(?:{pattern})")


def test_pattern(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """The values with whether each fits."""
    return df.select(F.col(column).alias("value"), regex_valid(F.col(column), pattern).alias("matches"))


def _digit(x: Column, i: Column) -> Column:
    return F.ascii(F.substr(x, i, F.lit(1))) - 48


def za_id_valid(x: Column) -> Column:
    """13 digits with a Luhn sum that 10 divides."""

    def part(i: Column) -> Column:
        double = _digit(x, i + 1) * 2
        return F.when(i % 2 == 0, _digit(x, i + 1)).otherwise(F.when(double > 9, double - 9).otherwise(double))

    total = F.aggregate(F.sequence(F.lit(0), F.lit(12)), F.lit(0), lambda s, i: s + part(i))
    return F.when(x.rlike(r"^\d{13}\z"), total % 10 == 0).otherwise(False)


def iban_valid(x: Column) -> Column:
    """Remainder 1 by 97, folded over the characters; other symbols are wrong."""
    clean = F.upper(F.replace(x, F.lit(" "), F.lit("")))
    moved = F.concat(F.substring(clean, 5, 40), F.substring(clean, 1, 4))

    def fold(s: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (s * 100 + code - 55) % 97).otherwise((s * 10 + code - 48) % 97)

    return F.when(clean.rlike(PATTERNS["iban"].replace("$", r"\z")), F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(fold(s, c))) == 1).otherwise(False)


def register_rule(name: str, fn: Callable[[Column], Column]) -> None:
    """K8: a rule of the caller: from a column to a true or false column."""
    _RULES[name] = lambda x, given: Verdict(F.coalesce(fn(x), F.lit(False)), F.lit(f"Rule {name} failed"))


def _says(name: str, *values) -> Column:
    return F.lit(MESSAGES[name].format(*values))


def _named(name: str) -> str:
    """A named pattern, whose end is the text's end and not also before a last line feed."""
    return PATTERNS[name].replace("$", r"\z")


def _bound(kind: str, default: int, measure: Callable[[Column], Column], holds: Callable[[Column, object], Column], note: Callable[[Column, object], Column]) -> Callable[[Column, Given], Verdict]:
    """A rule that compares what is measured of a value with the parameter named like the bound, or by its first three letters."""

    def rule(x: Column, given: Given) -> Verdict:
        limit = given.options.get(kind, given.options.get(kind[:3], default))
        return Verdict(F.coalesce(holds(measure(x), limit), F.lit(False)), note(measure(x), limit))

    return rule


def _number(x: Column) -> Column:
    return F.when(x.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"), F.trim(x).try_cast("double"))


def _length_note(kind: str) -> Callable[[Column, object], Column]:
    return lambda n, limit: F.concat(_says(kind, limit), n.cast("string"))


def _number_note(kind: str) -> Callable[[Column, object], Column]:
    return lambda n, limit: F.when(n.isNull(), _says("number")).otherwise(_says(kind, float(limit)))


def _regex(x: Column, given: Given) -> Verdict:
    known = given.pattern in PATTERNS
    return Verdict(regex_valid(x, _named(given.pattern) if known else given.pattern), _says("regex", PATTERNS[given.pattern] if known else given.pattern))


def _enum(x: Column, given: Given) -> Verdict:
    allowed = list(given.options.get("values", []))
    return Verdict(x.isin(allowed), _says("enum", allowed))


def _enum_ci(x: Column, given: Given) -> Verdict:
    allowed = [v.strip().lower() for v in given.pattern.split(",")]
    return Verdict(F.lower(x).isin(allowed), _says("enum_ci", ", ".join(allowed)))


def _phone(x: Column, given: Given) -> Verdict:
    digits = F.regexp_replace(x, r"[\s\-()]", "")
    return Verdict(digits.rlike(_named("phone_international")), _says("phone_e164"), digits)


def _iban(x: Column, given: Given) -> Verdict:
    shape = F.upper(F.replace(x, F.lit(" "), F.lit("")))
    return Verdict(iban_valid(x), F.when(shape.rlike(_named("iban")), _says("iban_checksum")).otherwise(_says("iban_format")), shape)


def _date(x: Column, given: Given) -> Verdict:
    form = given.options.get("format", "yyyy-MM-dd")
    return Verdict(F.try_to_date(x, form).isNotNull(), _says("date_format", form))


_RULES |= {
    "required": lambda x, given: Verdict(F.trim(x) != "", _says("required")),
    "luhn": lambda x, given: Verdict(za_id_valid(x), _says("luhn")),
    "email": lambda x, given: Verdict(x.rlike(_named("email_rfc5322")), _says("email"), F.trim(F.lower(x))),
    "min_length": _bound("min_length", 0, F.length, lambda n, least: n >= least, _length_note("min_length")),
    "max_length": _bound("max_length", 9999, F.length, lambda n, most: n <= most, _length_note("max_length")),
    "min": _bound("min", 0, _number, lambda n, least: n >= float(least), _number_note("min")),
    "max": _bound("max", 0, _number, lambda n, most: n <= float(most), _number_note("max")),
    "regex": _regex,
    "enum": _enum,
    "enum_ci": _enum_ci,
    "phone_e164": _phone,
    "iban_checksum": _iban,
    "date_format": _date,
}


def validate_field(x: Column, kind: str, pattern: str | None = None, message: str | None = None, **options) -> Column:
    """Struct of status (pass, fail or warning), error and cleaned. A null value is empty; an unknown rule warns."""
    raw = F.coalesce(x.cast("string"), F.lit(""))
    if kind not in _RULES:
        status, error, cleaned = F.lit("warning"), F.lit(f"Unknown rule type: {kind}"), raw
    else:
        found = _RULES[kind](raw, Given(pattern or "", options))
        status, error = F.when(found.ok, "pass").otherwise("fail"), F.when(~found.ok, F.lit(message) if message else found.error)
        # only a required value that is missing has no cleaned form
        cleaned = F.when(found.ok, raw) if kind == "required" else raw if found.clean is None else F.when(found.ok, found.clean).otherwise(raw)
    return F.struct(status.alias("status"), error.alias("error"), cleaned.alias("cleaned"))


def validate(df: DataFrame, rules: list[dict], key: str) -> DataFrame:
    """A row for each record and rule: key, field_name, rule, value, status, error, cleaned. An absent field is empty.

    The rules become columns on the driver, so the records pass one narrow stage.
    """

    def one(rule: dict) -> Column:
        given = {k: v for k, v in rule.items() if k not in ("field", "kind")}
        x = F.col(f"`{rule['field']}`") if rule["field"] in df.columns else F.lit(None).cast("string")
        r = validate_field(x, rule["kind"], **given)
        return F.struct(F.lit(rule["field"]).alias("field_name"), F.lit(rule["kind"]).alias("rule"), F.coalesce(x.cast("string"), F.lit("")).alias("value"), r["status"].alias("status"), r["error"].alias("error"), r["cleaned"].alias("cleaned"))

    return df.select(F.col(f"`{key}`"), F.explode(F.array(*[one(r) for r in rules])).alias("r")).select(key, "r.*")


def validation_summary(results: DataFrame) -> DataFrame:
    """D3: counts by status, and whether none failed or warns."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(n("pass").alias("passed"), n("fail").alias("failed"), n("warning").alias("warnings"), (n("pass") == F.count("*")).alias("all_resolved"))


def accept_warnings(results: DataFrame) -> DataFrame:
    return results.withColumn("status", F.when(F.col("status") == "warning", "pass").otherwise(F.col("status")))
