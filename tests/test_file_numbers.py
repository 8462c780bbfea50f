"""The number of files that a query writes doesn't grow with each row."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from folioflow.plans import files
from folioflow.sources.files import read_json_rows


def test_single_objects_fill_a_bounded_number_of_files(spark, tmp_path):
    orders = spark.range(60_000).select(F.col("id").alias("o_orderkey"), F.lit("O").alias("o_orderstatus"))
    path = f"file://{tmp_path}/json"
    files._json_files(SimpleNamespace(spark=spark, orders=orders), path)
    assert 300 < len(list(tmp_path.rglob("*.json"))) < 700
    got = read_json_rows(spark, f"{path}/*/*.json").select(F.get_json_object("record", "$.o_orderkey").cast("long").alias("k"))
    assert got.agg(F.count("*"), F.count_distinct("k"), F.sum("k")).first()[:] == (60_000, 60_000, 60_000 * 59_999 // 2)
