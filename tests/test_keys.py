"""Keys and other columns pass operators as they are, beside nulls and beyond what a double holds."""

import datetime

import pytest
from pyspark.sql import functions as F

from folioflow.operators import chunks, models
from folioflow.sources import files

KEYS = [2**53, 2**53 + 1, None, -5]
TEXT = "one two three\n\nfour five. six seven\n\n" + "eight nine ten " * 20


def keyed(spark, kind="long", keys=KEYS):
    return spark.createDataFrame([(k, i, "user", f"{i} {TEXT}") for i, k in enumerate(keys)], f"doc {kind}, turn int, role string, text string").coalesce(1)


@pytest.mark.parametrize("cut", [chunks.word_chunks, chunks.char_chunks, chunks.line_chunks, chunks.document_chunks, chunks.ingest_chunks, lambda *a: chunks.line_chunks(*a, size=40, carry=1)])
def test_chunks_keep_their_keys(spark, cut):
    got = cut(keyed(spark), "doc", "text").select("doc", "chunk", "text").collect()
    assert {(r.doc, 0) for r in got if r.chunk == 0} == {(k, 0) for k in KEYS}
    for i, k in enumerate(KEYS):
        own = sorted((r.chunk, r.text) for r in got if r.doc == k)
        assert [c for c, _ in own] == list(range(len(own))) and own[0][1].startswith(f"{i} one")


def test_sessions_of_nearly_equal_keys_stay_apart(spark):
    df = keyed(spark, keys=KEYS * 2)
    got = chunks.session_chunks(df, "doc", "turn", "role", "text", 10_000).collect()
    assert sorted((r.doc is None, r.doc or 0, r.start_idx, r.end_idx) for r in got) == sorted((k is None, k or 0, 0, 1) for k in KEYS)
    nan = spark.createDataFrame([(float("nan"), 0, "u", "a"), (float("nan"), 1, "u", "b")], "doc double, turn int, role string, text string")
    assert [r.text for r in chunks.session_chunks(nan, "doc", "turn", "role", "text").collect()] == ["u: a\nu: b"]
    assert chunks.session_chunks(df.limit(0), "doc", "turn", "role", "text").count() == 0


def test_models_pass_all_columns_on(spark):
    when, day = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901), datetime.date(2024, 1, 2)
    rows = [(k, "p", when, day, [1, None], {"a": 2**60}) for k in KEYS]
    df = spark.createDataFrame(rows, "id long, prompt string, at timestamp, day date, list array<long>, held map<string,long>").withColumn("reply", F.lit(7))
    out = models.model_map(df.coalesce(1), "prompt", lambda: lambda some: [x + "!" for x in some])
    assert sorted(map(repr, out.drop("reply", "error").collect())) == sorted(map(repr, df.drop("reply").collect()))
    assert {(r.reply, r.error) for r in out.collect()} == {("p!", None)}
    short = models.model_map(df, "prompt", lambda: lambda some: [], retries=0).collect()
    assert all(r.reply is None and "replies" in r.error for r in short)


def test_json_of_every_shape_in_a_mixed_folder(spark, tmp_path):
    shapes = {"a.json": '[{"k": 1}, {"k": 2}]', "b.json": '{"rows": [{"k": 3}]}', "c.json": '{"data": {"rows": [{"k": 4}, {"k": 5}]}}', "d.json": ' {"k": 6}\n', "e.json": "not json", "f.json": "", "g.jsonl": '{"k": 7}\n\n{"k": 8}\n'}
    for name, text in shapes.items():
        (tmp_path / name).write_text(text)
    _, rows = files.extract_files(spark, str(tmp_path))
    assert sorted(r.cells[0] for r in rows.collect()) == list("12345678")


def test_csv_cells_with_line_feeds(spark, tmp_path):
    from folioflow.sources.sinks import export

    df = spark.createDataFrame([("1", 'a\nb "c", d'), ("2", None), ("3", "x")], "k string, v string").coalesce(1)
    export(df, str(tmp_path / "x"), "csv")
    assert sorted(map(tuple, files.read_csv_strings(spark, str(tmp_path / "x")).collect())) == [("1", 'a\nb "c", d'), ("2", ""), ("3", "x")]
