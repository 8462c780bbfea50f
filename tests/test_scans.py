"""The automaton, the JSON scanner and the kept table against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import automaton, chunks, memory, records


def test_automaton_finds_all_strings():
    rnd = random.Random(4)
    for _ in range(60):
        strings = sorted({bytes(rnd.choice(b"ab\xc3") for _ in range(rnd.randrange(1, 7))) for _ in range(rnd.randrange(1, 30))})
        texts = [bytes(rnd.choice(b"ab\xc3c") for _ in range(rnd.randrange(0, 40))) for _ in range(20)]
        text, string = automaton.Automaton(strings).find(texts)
        assert list(zip(text.tolist(), string.tolist(), strict=True)) == [(i, j) for i, x in enumerate(texts) for j, s in enumerate(strings) if s in x]
    none = automaton.Automaton([])
    assert [len(x) for x in none.find([b"a"])] == [0, 0]


def test_automaton_at_the_edges_of_lanes(monkeypatch):
    strings = [b"x" * 50 + b"y", b"abc", b"bc", b"z" * 3000]
    texts = [b"-" * (automaton.LANE - k) + s for s in strings for k in range(0, 52, 5)] + [b""]
    text, string = automaton.Automaton(strings).find(texts)
    assert list(zip(text.tolist(), string.tolist(), strict=True)) == [(i, j) for i, x in enumerate(texts) for j, s in enumerate(strings) if s in x]
    monkeypatch.setattr(automaton, "TOGETHER", 100)
    again = automaton.Automaton(strings).find(texts)
    assert again[0].tolist() == text.tolist() and again[1].tolist() == string.tolist()


def test_a_hundred_thousand_anchors(spark):
    anchors = spark.range(100_000).select(F.concat(F.lit("t"), F.pmod("id", F.lit(1000))).alias("name"), F.concat(F.lit("Anchor "), "id", F.lit(";")).alias("anchor"))
    pages = spark.createDataFrame([(1, "x anchor 77; ANCHOR 1077; anchor 5"), (2, None), (3, "anchor 99999;" * 5000), (4, "")], "k int, name string")
    got = sorted(tuple(r) for r in chunks.match_anchors(pages.withColumn("text", F.col("name")), anchors, "text").select("k", "name").collect())
    assert got == [(1, "t77"), (3, "t999")]
    both = spark.createDataFrame([("a", ""), ("b", "É"), ("b", None), (None, "x")], "name string, anchor string")
    got = sorted(tuple(r) for r in chunks.match_anchors(pages.withColumn("text", F.concat("name", F.lit("é"))), both, "text").select("k", "name").collect())
    assert got == [(k, n) for k in (1, 3, 4) for n in "ab"]
    with pytest.raises(ValueError):
        chunks.match_anchors(pages, anchors, "name", most_bytes=1000)


def leaves(x, path=()):
    items = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else None
    if items is None:
        return [(".".join(map(str, path)), None if x is None else str(x).lower() if isinstance(x, bool) else str(x))] if path else []
    return [y for k, v in items for y in leaves(v, (*path, k))]


def test_json_leaves_equal_a_plain_walk(spark):
    rnd = random.Random(8)

    def made(depth):
        kind = rnd.randrange(7 if depth else 5)
        if kind < 5:
            return [None, True, False, rnd.randrange(-(10**6), 10**6), rnd.choice(["", "a\"b\\c", "é,{}[]:\n", "null", "1"])][kind]
        if kind == 5:
            return [made(depth - 1) for _ in range(rnd.randrange(4))]
        return {rnd.choice(["a", "b.c", "", 'q"', "1", "{"]) + str(i): made(depth - 1) for i in range(rnd.randrange(4))}

    given = [made(5) for _ in range(300)] + [[[]], {}, [{"a": {}}]]
    texts = [json.dumps(x, indent=i % 3 or None, ensure_ascii=i % 2 == 0) for i, x in enumerate(given)]
    got = memory.flatten_json(spark.createDataFrame(list(enumerate(texts)), "k int, j string"), "k", "j").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *y)) for i, x in enumerate(given) for y in leaves(x))


def test_json_numbers_and_what_is_no_json(spark):
    rows = [(2**53 + 1, '{"a": 1.50, "b": -0.0, "c": 1e3, "d": 12345678901234567890, "e": 1.0}'), (None, "{bad"), (2**53, None), (1, ""), (2, "[1,]")]
    got = {(r.k, r.path): r.value for r in memory.flatten_json(spark.createDataFrame(rows, "k long, j string"), "k", "j").collect()}
    assert got == {(2**53 + 1, p): v for p, v in {"a": "1.5", "b": "0", "c": "1000.0", "d": "12345678901234567890", "e": "1"}.items()}


def test_kept_table_leaves_untouched_files_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    files = lambda: {f.relative_to(tmp_path): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(200)] + [(None, "none")], "k long, v string")
    assert records.upsert_kept(spark, path, rows, ["k"], 16) == 16
    before = files()
    changes = spark.createDataFrame([(7, "new"), (None, "other")], "k long, v string")
    n = records.upsert_kept(spark, path, changes, ["k"], 99)
    after = files()
    assert n <= 2 and len({f.parent for f in before if f not in after}) == n
    want = {i: f"v{i}" for i in range(200)} | {7: "new", None: "other"}
    assert sorted(map(repr, spark.read.parquet(path).select("k", "v").collect())) == sorted(f"Row(k={k!r}, v={v!r})" for k, v in want.items())
    assert records.upsert_kept(spark, path, changes.limit(0), ["k"]) == 0 and files() == after
