"""Mapping field names and remembering file structures.

Best matches are found by a join on parts of names, so the lists may be of any length. Only name_pairs scores all pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import name_similarity, normalize_name

#: Names on the smaller side up to which every pair is scored from a broadcast.
NAMES = 20_000
#: The score of a name that contains the other.
CONTAINED = 0.85


def name_pairs(source: DataFrame, target: DataFrame, s: str, u: str) -> DataFrame:
    """All pairs of the two lists with their similarity. The target list is counted first and must have at most NAMES names."""
    if target.limit(NAMES + 1).count() > NAMES:
        raise ValueError(f"over {NAMES} target names: take similar_pairs")
    return source.select(s).join(F.broadcast(target.select(u)), F.lit(True)).withColumn("score", name_similarity(F.col(s), F.col(u)))


def candidate_pairs(source: DataFrame, target: DataFrame, s: str, u: str, threshold: float) -> DataFrame:
    """(x, y): distinct pairs of normalized names, among them all of at least the threshold, without pairing all names.

    Names that are equal meet by themselves, and one that contains another by its substrings. For all others the common
    prefix and suffix together are threshold times the longer length, so one of them is half of that at least: the
    longer name sends its own prefix and suffix of that length, a shorter one those for each longer length that may be.
    """
    norm = lambda df, c: df.select(normalize_name(F.col(c)).alias("x")).dropna().distinct().withColumn("l", F.length("x"))
    a, b = norm(source, s), norm(target, u)
    need = lambda m: F.greatest(F.lit(1), F.ceil(m * threshold / 2 - 1e-9)).cast("int")

    def ends(df: DataFrame, lengths: Column) -> DataFrame:
        """(m, suffix, part, x): both ends of a name as long as a partner of each longer length needs."""
        each = df.select("x", "l", F.explode(lengths).alias("m")).withColumn("k", need(F.col("m"))).filter("k <= l")
        both = F.array(F.struct(F.lit(False).alias("suffix"), F.expr("left(x, k)").alias("part")), F.struct(F.lit(True).alias("suffix"), F.expr("right(x, k)").alias("part")))
        return each.select("x", "m", F.inline(both))

    own, longest = F.array("l"), F.floor(2 * F.col("l") / threshold + 1e-9).cast("int")
    longer = lambda df: F.when(longest >= df, F.sequence(df, longest)).otherwise(F.array().cast("array<int>"))
    keys = ["m", "suffix", "part"]
    found = [
        a.select("x", F.col("x").alias("y")).join(b.select("x"), "x", "left_semi").select("x", "y"),
        ends(a, own).join(ends(b, longer(F.col("l"))).withColumnRenamed("x", "y"), keys).select("x", "y"),
        ends(a, longer(F.col("l") + 1)).join(ends(b, own).withColumnRenamed("x", "y"), keys).select("x", "y"),
    ]
    if threshold <= CONTAINED:
        starts = F.when(F.col("l") > 0, F.sequence(F.lit(1), F.col("l"))).otherwise(F.array().cast("array<int>"))
        parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.col("l") - i + 1), lambda n: F.substr(F.col("x"), i, n))))
        inside = lambda df: df.select("x", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), parts))).alias("part"))
        found.append(inside(a).join(b.select(F.col("x").alias("part")), "part").select("x", F.col("part").alias("y")))
        found.append(inside(b).withColumnRenamed("x", "y").join(a.select(F.col("x").alias("part")), "part").select(F.col("part").alias("x"), "y"))
    return reduce(DataFrame.union, found).distinct()


def similar_pairs(source: DataFrame, target: DataFrame, s: str, u: str, threshold: float) -> DataFrame:
    """All pairs of at least the threshold (over 0): s, u, score. Null names match nothing."""
    if threshold <= 0:
        raise ValueError("a threshold over 0; name_pairs scores all pairs")
    scored = candidate_pairs(source, target, s, u, threshold).withColumn("score", name_similarity(F.col("x"), F.col("y"))).filter(F.col("score") >= threshold)
    a, b = source.select(s).withColumn("x", normalize_name(F.col(s))), target.select(u).withColumn("y", normalize_name(F.col(u)))
    return scored.join(a, "x").join(b, "y").select(s, u, "score")


def fuzzy_map(source: DataFrame, target: DataFrame, s: str, u: str, threshold: float = 0.7) -> DataFrame:
    """Each source name's best target of at least the threshold, the first by name on ties: s, u, confidence."""
    pairs = similar_pairs(source, target, s, u, threshold)
    return pairs.groupBy(s).agg(F.min_by(F.struct(u, "score"), F.struct(-F.col("score"), F.col(u))).alias("b")).select(s, f"b.{u}", F.col("b.score").alias("confidence"))


def unmapped(fields: DataFrame, mappings: DataFrame, name: str) -> DataFrame:
    return fields.select(name).join(mappings.select(name), name, "left_anti")


def map_fields(source: DataFrame, target: DataFrame, manual: DataFrame, threshold: float = 0.7, ignore: list[str] = ()) -> DataFrame:
    """Manual pairs of names that both sides have (confidence 1), then the best match of the rest: source, target, confidence."""
    source = source.filter(~F.col("source").isin(list(ignore)))
    fixed = manual.join(source, "source", "left_semi").join(target, "target", "left_semi").select("source", "target", F.lit(1.0).alias("confidence"))
    rest = fuzzy_map(unmapped(source, fixed, "source"), unmapped(target, fixed, "target"), "source", "target", threshold)
    return fixed.unionByName(rest)


def mapping_summary(mappings: DataFrame) -> DataFrame:
    return mappings.agg(F.count("*").alias("mapped"), F.coalesce(F.round(F.avg("confidence"), 6), F.lit(0.0)).alias("confidence"))


def infer_types(df: DataFrame, json: str, order: list[str]) -> DataFrame:
    """Field and type of the first record's values; a top-1, so only that record is looked at."""
    first = df.sort(*order).limit(1).select(F.parse_json(json).alias("v"))
    date = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{4}/\d{2}/\d{2})"
    rows = df.sparkSession.sql("SELECT f.key AS field, f.value AS value FROM {d}, LATERAL variant_explode(v) f", d=first)
    kind = F.schema_of_variant("value")
    text = F.try_variant_get("value", "$", "string")
    out = F.when(kind == "BOOLEAN", "boolean").when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(kind.rlike("DECIMAL|DOUBLE|FLOAT"), "float").when((kind == "STRING") & text.rlike(date), "date").otherwise("string")
    return rows.select("field", out.alias("type"))


def sample_context(v: Column) -> Column:
    """What a sample value is: its type with its first 50 characters, or its size or first three keys."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    shown = lambda name: F.concat(F.lit(f"{name} (sample: "), F.substring(text, 1, 50), F.when(F.length(text) > 50, "...").otherwise(""), F.lit(")"))
    return (
        F.when(kind == "BOOLEAN", shown("boolean"))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), shown("number"))
        .when(kind == "STRING", shown("string"))
        .when(kind.startswith("ARRAY"), F.concat(F.lit("array (length: "), F.json_array_length(F.to_json(v)).cast("string"), F.lit(")")))
        .when(kind.startswith("OBJECT"), F.concat(F.lit("object (keys: "), F.array_join(F.slice(F.json_object_keys(F.to_json(v)), 1, 3), ", "), F.lit(")")))
    )


def structure_registry(files: DataFrame, hash_: str, path: str, at: str) -> DataFrame:
    """For each structure its files, distinct paths (in order, and how many) and last use."""
    return files.groupBy(hash_).agg(F.count("*").alias("usage_count"), F.countDistinct(path).alias("n_paths"), F.max(at).alias("last_used"))


def find_structure(cache: DataFrame, keys: DataFrame, on: list[str], at: str) -> DataFrame:
    """C14: each key with the latest cache entry's value of at, or null."""
    latest = cache.groupBy(*on).agg(F.max(at).alias(at))
    return keys.join(latest, on, "left")

