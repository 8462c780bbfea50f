"""Records in model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_json_reply(x: Column) -> Column:
    """An array of the reply's records as JSON text, or null.

    Code fences go; then the reply, or its widest [...] or {...}, is read: a list, an object's rows, data or
    detectedTemplates, or the object itself. Failing that, each flat {...} that can be read.
    """
    plain = F.regexp_replace(x, r"```(?:json)?", "")
    from_list = F.regexp_extract(plain, r"(?s)(\[.*\])", 1)
    from_object = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)

    def listed(j: Column) -> Column:
        return F.from_json(j, "array<string>", {"mode": "PERMISSIVE"})

    # in brackets, as the parser stops at the end of a first value
    good = lambda j: (j != "") & F.try_parse_json(F.concat(F.lit("["), j, F.lit("]"))).isNotNull()
    inner = F.coalesce(*[F.get_json_object(from_object, f"$.{k}") for k in ("rows", "data", "detectedTemplates")])
    flat = F.filter(F.regexp_extract_all(plain, F.lit(r"(\{[^{}]*\})"), F.lit(1)), good)
    starts_as_object = F.ltrim(plain).startswith("{")
    return (
        F.when(starts_as_object & good(from_object), F.coalesce(listed(inner), F.array(from_object)))
        .when(good(from_list) & (from_list != ""), listed(from_list))
        .when(good(from_object) & (from_object != ""), F.coalesce(listed(inner), F.array(from_object)))
        .when(F.size(flat) > 0, flat)
    )


def reply_records(df: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, i, record, error): a row for each record; a reply without any gives an error and its first 500 characters."""
    rows = df.select(key, F.col(reply).alias("__r"), parse_json_reply(F.col(reply)).alias("__l"))
    some = rows.filter(F.size("__l") > 0).select(key, F.posexplode("__l").alias("i", "record"), F.lit(None).cast("string").alias("error"))
    none = rows.filter(F.col("__l").isNull()).select(key, F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("record"), F.concat(F.lit("no records: "), F.substring("__r", 1, 500)).alias("error"))
    return some.unionByName(none)
