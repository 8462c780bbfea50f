"""Editing tables of records (B, C2-C4, C12, G3-G6, A13, A14, E9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.hashing import record_hash
from folioflow.sources.shared import shared_folder, written

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(x: Column) -> Column:
    """The number that a text spells, else null."""
    text = x.cast("string")
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def transform(df: DataFrame, mapping: dict[str, str], fill_unmapped: bool = False) -> DataFrame:
    """B1: mapped columns under their new names; the others go, or stay with fill_unmapped."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in mapping and c not in mapping.values()] if fill_unmapped else []
    return df.select(*[F.col(f"`{s}`").alias(t) for s, t in mapping.items() if s in df.columns], *rest)


def add_column(df: DataFrame, name: str, default=None, position: str | None = None, ref: str | None = None, cond: Column | None = None) -> DataFrame:
    """B2: a column of the default (where cond holds, else null), at the end, or before or after ref; a column that exists stays as it is."""
    if name in df.columns:
        return df
    order = list(df.columns)
    at = order.index(ref) + (position == "after") if ref in order else len(order)
    order.insert(at, name)
    value = F.lit(default)
    return df.withColumn(name, value if cond is None else F.when(cond, value)).select(*[F.col(f"`{c}`") for c in order])


def remove_columns(df: DataFrame, names: list[str]) -> tuple[DataFrame, int]:
    """Df without the columns, and how many there were."""
    found = [n for n in names if n in df.columns]
    return df.drop(*found), len(found)


def condition(df: DataFrame, field: str, op: str, value, trimmed: bool = False) -> Column:
    """Text comparisons blind to case, number comparisons false for what is no number; false for a missing field."""
    if field not in df.columns:
        return F.lit(False)
    x = F.col(f"`{field}`")
    text = F.lower(x.cast("string"))
    text, low = (F.trim(text), str(value).strip().lower()) if trimmed else (text, str(value).lower())
    n = number(x)
    made = {
        "equals": lambda: text == low,
        "not_equals": lambda: text != low,
        "contains": lambda: text.contains(low),
        "greater_than": lambda: n > float(value),
        "less_than": lambda: n < float(value),
        "greater_equal": lambda: n >= float(value),
        "less_equal": lambda: n <= float(value),
    }[op]()
    return F.coalesce(made, F.lit(False))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def remove_rows(df: DataFrame, cond: Column) -> DataFrame:
    """A row whose condition is null stays."""
    return df.filter(~F.coalesce(cond, F.lit(False)))


def remove_empty(df: DataFrame, field: str) -> DataFrame:
    return df.filter(F.coalesce(F.col(field).cast("string"), F.lit("")) != "")


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """df with position, from 0 in the given order, which should be total.

    Rows are dealt by ranges of the order and written, so that the ranges are fixed; a row's position is its place in
    its range and the sizes of the ranges before. Only these sizes, one for each range, meet in one task.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "positions")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__range", T.IntegerType())])).parquet(path)
    sizes = rows.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return rows.withColumn("position", place).join(F.broadcast(before), "__range").withColumn("position", F.col("position") + F.col("before")).drop("__range", "before")


def remove_positions(df: DataFrame, order: list[str], places: list[int]) -> DataFrame:
    return positions(df, order).filter(~F.col("position").isin(places)).drop("position")


def take_positions(df: DataFrame, order: list[str], places: list[int]) -> DataFrame:
    return positions(df, order).filter(F.col("position").isin(places)).drop("position")


def complete_to_schema(df: DataFrame, fields: list[str]) -> DataFrame:
    """Exactly the fields; a missing one, and null, is empty text."""
    return df.select(*[F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields])


def cells_to_columns(df: DataFrame, cells: str, columns: list[str]) -> DataFrame:
    """An array's cells under names; further cells are cut."""
    return df.select(*[F.get(F.col(cells), F.lit(i)).alias(c) for i, c in enumerate(columns)])


def diff_records(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Key, field and status (changed, added, removed, unchanged) of each field's digest in either table.

    One full join by key, then the fields side by side: rows are not multiplied before the shuffle.
    """
    fields = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    digest = lambda df, side: df.select(F.col(key), F.struct(*[(F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("null")), 256) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in fields]).alias(side))
    both = digest(old, "o").join(digest(new, "n"), key, "full")
    one = lambda c: F.struct(F.lit(c).alias("field"), F.when(F.col(f"o.`{c}`").isNull(), "added").when(F.col(f"n.`{c}`").isNull(), "removed").when(F.col(f"o.`{c}`") == F.col(f"n.`{c}`"), "unchanged").otherwise("changed").alias("status"), (F.col(f"o.`{c}`").isNotNull() | F.col(f"n.`{c}`").isNotNull()).alias("there"))
    return both.select(key, F.explode(F.array(*[one(c) for c in fields])).alias("d")).filter("d.there").select(key, "d.field", "d.status")


def merge_subset(original: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """The original with the rows that the edits have; keys that only the edits have are not added."""
    e = edits.select(F.col(key), F.struct(*[F.col(f"`{c}`") for c in original.columns]).alias("__e"))
    pick = lambda c: F.when(F.col("__e").isNotNull(), F.col(f"__e.`{c}`")).otherwise(F.col(f"`{c}`")).alias(c)
    return original.join(e, key, "left").select(*[F.col(key) if c == key else pick(c) for c in original.columns])


def verify_changes(protected: DataFrame, edits: DataFrame) -> DataFrame:
    """C4: each edit with status invalid (no or an unknown _hash), unchanged or modified, and the old and new record."""
    own = [c for c in protected.columns if c != "_hash"]
    old = protected.select("_hash", F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("old"), F.lit(True).alias("__known")).dropDuplicates(["_hash"])
    new = edits.select("*", record_hash(own).alias("__new"), F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("new"))
    status = F.when(F.col("__known").isNull(), "invalid").when(F.col("__new") == F.col("_hash"), "unchanged").otherwise("modified")
    return new.join(old, "_hash", "left").select("_hash", status.alias("status"), "old", "new", *own)


def insert_missing(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The target and the new rows whose key it lacks, one for each."""
    return target.unionByName(new.dropDuplicates([key]).join(target.select(key), key, "left_anti").select(*target.columns))


def cascade_delete(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C11: both tables without the parents in gone (a column named as parent_key)."""
    return parents.join(gone, parent_key, "left_anti"), children.join(gone.withColumnRenamed(parent_key, child_key), child_key, "left_anti")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Updates win; one row for each key, found by an aggregate that keeps one row for each key and task."""
    both = target.withColumn("__p", F.lit(1)).unionByName(updates.withColumn("__p", F.lit(0)))
    rest = [c for c in target.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), "__p").alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.`{c}`").alias(c) for c in target.columns])


def upsert_kept(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], parts: int = 64) -> int:
    """A13 on a table that is kept in partitions by the keys' hash: updates win; returns the number of partitions written anew.

    Only partitions that updates fall into are read, merged into a folder of their own and then swapped in; the files of
    all others stay as they are. A table that isn't there yet is made with so many parts, which it keeps; updates of one
    key are to be one row.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    sized = spark._jvm.org.apache.hadoop.fs.Path(path, f"_parts={parts}")
    there = fs.exists(folder) and fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "_parts=*"))
    if there:
        parts = int(there[0].getPath().getName().split("=")[1])
    dealt = updates.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(parts)))
    new = written(dealt, "upsert")
    touched = [r[0] for r in new.select("__part").distinct().collect()]  # parts at most
    if not touched:
        return 0
    if there:
        held = spark.read.option("basePath", path).parquet(path).filter(F.col("__part").isin(touched))
        new = upsert(held.select(*new.columns[:-1], F.col("__part").cast("long").alias("__part")), new, [*keys, "__part"])
    merged = written(new, "upsert-merged")
    merged.repartition("__part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__part").parquet(path)
    fs.create(sized, True).close()
    return len(touched)


def delete_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def get_where(df: DataFrame, where: Column) -> DataFrame:
    """The rows whose metadata fit."""
    return df.filter(where)


def count_where(df: DataFrame, where: Column, by: str) -> DataFrame:
    """How many rows of each value of by fit."""
    return get_where(df, where).groupBy(by).agg(F.count("*").alias("n"))


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Each distinct row once."""
    return df.dropDuplicates()


def dedupe_signature(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The first row of each signature, the values that are not empty in order; rows without any go."""
    values = F.filter(F.array(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns]), lambda v: v != "")
    signed = df.withColumn("__s", F.sha2(F.array_join(values, "\u001f"), 256)).filter(F.size(values) > 0)
    best = signed.groupBy("__s").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def keep_richest(df: DataFrame, key: str, text: str, order: list[str]) -> DataFrame:
    """E5: of each key the row of the longest text, the first on ties."""
    best = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(-F.length(F.coalesce(F.col(text), F.lit(""))), *order)).alias("r"))
    return best.select("r.*")


def batch_rows(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Group, batch (from 0) and its rows' number, in order within each group."""
    numbered = df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / size).cast("long"))
    return numbered.groupBy(*group, "batch").agg(F.count("*").alias("expected"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def adaptive_size(n: Column) -> Column:
    """Rows in a batch by the number of rows."""
    out = None
    for most, size in ((30, 1), (60, 2), (120, 3), (240, 5), (500, 8)):
        out = F.when(n <= most, size) if out is None else out.when(n <= most, size)
    return out.otherwise(10)
