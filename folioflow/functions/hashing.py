"""Digests of texts, records and schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def hash_fields(df: DataFrame, columns: list[str]) -> Column:
    """H2: a map from each field to its digest: text as it is, others as JSON text."""
    kinds = dict(df.dtypes)
    text = lambda c: F.col(c) if kinds[c] == "string" else F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.sha2(text(c), 256))])


def record_hash(columns: list[str]) -> Column:
    """H4: the digest of the record's JSON with fields in order of name; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def protect(df: DataFrame) -> DataFrame:
    return df.withColumn("_hash", record_hash(df.columns))


def hmac_sign(x: Column, key: bytes) -> Column:
    """H5: HMAC-SHA256 in hex; the pads are made on the driver."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = lambda b: F.unhex(F.lit(bytes(k ^ b for k in key.ljust(64, b"\0")).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), x.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def hmac_verify(x: Column, key: bytes, signature: Column) -> Column:
    return F.coalesce(hmac_sign(x, key) == F.lower(signature), F.lit(False))


def structure_hash(types: Column) -> Column:
    """H6: 16 hex digits of the digest of a map from column to type, in order of column."""
    pairs = F.array_sort(F.transform(F.map_entries(types), lambda e: F.concat_ws(":", e["key"], e["value"])))
    return F.substring(F.sha2(F.array_join(pairs, ","), 256), 1, 16)


def hash_embedding(x: Column) -> Column:
    """[sin h, cos h, (h mod 7) / 7] with h from 0 to 999 of the digest."""
    h = F.pmod(F.conv(F.substring(F.sha2(x, 256), 1, 8), 16, 10).cast("long"), F.lit(1000))
    return F.array(F.sin(h), F.cos(h), (h % 7) / 7.0)


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit(x: Column) -> Column:
    """The vector at length 1, in doubles."""
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    # a list of one, so that the length is found once and not for each place
    return F.transform(F.array(size), lambda n: F.transform(x, lambda v: F.when(n > 0, v.cast("double") / n).otherwise(0.0)))[0]

