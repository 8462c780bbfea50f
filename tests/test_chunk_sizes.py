"""Chunks of many or long texts: memory and work stay in step with the text."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.operators import chunks

CUTTERS = {"word": chunks.word_chunks, "char": chunks.char_chunks, "line": chunks.line_chunks, "document": chunks.document_chunks}


@pytest.mark.parametrize("kind", CUTTERS)
def test_a_task_cuts_a_bounded_part_of_a_batch(spark, monkeypatch, kind):
    df = spark.createDataFrame([], "k long, text string")
    held = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: held.append(run) or self)
    CUTTERS[kind](df, "k", "text")
    text = ("some words in a line. " * 20 + "\n\n") * 20
    texts = ["", *[text] * 3_000, "last", text * 300, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"])
    tracemalloc.start()
    keys, rows = set(), 0
    for b in held[0](iter([batch])):
        keys.update(b.column(0).to_pylist())
        rows += b.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keys == set(range(1, len(texts) - 1)) and rows >= len(keys)
    assert peak < 40 << 20


def test_texts_are_cleaned_once_and_not_for_each_slice(spark):
    df = spark.createDataFrame([(1, "ab  cd " * 2_000), (2, None)], "k long, text string")
    got = chunks.atomic_records(df, "k", "text")
    assert got._jdf.queryExecution().optimizedPlan().toString().count(r"Page\s+\d+") == 1
    assert [r.text for r in got.sort("k", "chunk").collect()] == [("ab cd " * 2_000)[:-1][i : i + 2_500].strip() for i in range(0, 12_000, 2_500)]


def test_pages_are_parted_once_and_not_for_each_chunk(spark):
    df = spark.createDataFrame([(1, "a\fb\fc"), (2, "")], "k long, text string")
    got = chunks.page_chunks(df, "k", F.col("text"), sep="|")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Page ") == 1
    assert [(r.k, r.chunk, r.text) for r in got.sort("k", "chunk").collect()] == [(1, 0, "a|b"), (1, 1, "c")]
