"""Literal cases and properties of the operators."""

import hashlib
import hmac
import io
import random
import re
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import coerce, hashing, text, validate
from folioflow.operators import chunks, mapping, memory, records, retrieval
from folioflow.sources import files
from folioflow.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_digests(spark):
    assert one(spark, hashing.sha256(F.lit("hello"))) == hashlib.sha256(b"hello").hexdigest()
    for key in (b"key", b"k" * 100):
        assert one(spark, hashing.hmac_sign(F.lit("some text"), key)) == hmac.new(key, b"some text", "sha256").hexdigest()


def test_coercion(spark):
    assert one(spark, coerce.coerce_int(F.lit("  25  "))) == 25 and one(spark, coerce.coerce_int(F.lit("12.50"))) == 1250
    assert one(spark, coerce.coerce_float(F.lit("1,234.56"))) == 1234.56 and one(spark, coerce.coerce_bool(F.lit("Yes"))) is True
    assert str(one(spark, coerce.coerce_date(F.lit("2024-01-15")))) == "2024-01-15" and one(spark, coerce.coerce_date(F.lit("31 of May"))) is None
    for shown, amount in (("R 15,000.00", 15000.0), ("ZAR 5", 5.0), ("EUR 7.5", 7.5)):
        assert one(spark, coerce.coerce_currency(F.lit(shown)))["amount"] == amount


def test_validation(spark):
    v = lambda x, *a, **k: one(spark, validate.validate_field(F.lit(x), *a, **k))["status"]
    assert v("GB29 NWBK 6016 1331 9268 19", "iban_checksum") == "pass" and v("GB29 NWBK 6016 1331 9268 18", "iban_checksum") == "fail"
    assert v("8001015009087", "luhn") == "pass" and v("8001015009088", "luhn") == "fail"
    assert v("test@example.com", "email") == "pass" and v("not-an-email", "email") == "fail" and v("x", "none") == "warning"
    with pytest.raises(Exception):
        validate.regex_valid(F.lit("x"), "[invalid")


def test_flatten_and_keywords(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":1,"c":[2,3]},"d":{},"e":null}'), (2, "[[1],[]]"), (3, "no json"), (4, None)], "k int, j string")
    got = {(r["k"], r["path"], r["value"]) for r in memory.flatten_json(df, "k", "j").collect()}
    assert got >= {(1, "a.b", "1"), (1, "a.c.0", "2"), (1, "a.c.1", "3"), (2, "0.0", "1")} and len(got) <= 5
    docs = spark.createDataFrame([(1, "hello hello hello world the")], "id int, t string")
    assert {(r["keyword"], r["n"]) for r in retrieval.keyword_index(docs, "id", "t").collect()} == {("hello", 3), ("world", 1)}


def test_names(spark):
    sim = lambda a, b: one(spark, text.name_similarity(F.lit(a), F.lit(b)))
    assert sim("full_name", "FullName") == 1 and sim("name", "full_name") == 0.85 and sim("abbba", "abbbba") == 1 and sim("abc", "xyz") == 0
    s = spark.createDataFrame([("employee_id",), ("full_name",), ("dept",)], "source string")
    t = spark.createDataFrame([("id",), ("name",), ("department",)], "target string")
    manual = spark.createDataFrame([("dept", "department")], "source string, target string")
    assert {(r["source"], r["target"]) for r in mapping.map_fields(s, t, manual).collect()} == {("dept", "department"), ("employee_id", "id"), ("full_name", "name")}


def test_history_ends_in_cycles(spark):
    edges = spark.createDataFrame([(i, i - 1, "updates") for i in range(1, 41)] + [(100, 101, "updates"), (101, 100, "updates")], "src long, dst long, type string")
    got = memory.memory_history(edges, spark.createDataFrame([(40,), (100,)], "id long")).collect()
    assert sorted(r["node"] for r in got if r["id"] == 40) == list(range(41)) and {r["node"] for r in got if r["id"] == 100} == {100, 101}


def test_history_of_a_long_chain_is_whole(spark):
    long, ring = 150, 90
    rows = [(i, i - 1, "updates") for i in range(1, long + 1)] + [(1000 + i, 1000 + (i + 1) % ring, "updates") for i in range(ring)] + [(2000, 1000, "updates"), (3000, 3000, "updates")]
    edges = spark.createDataFrame(rows, "src long, dst long, type string")
    got = memory.memory_history(edges, spark.createDataFrame([(long,), (1000,), (2000,), (3000,), (9999,)], "id long")).collect()
    steps = {(r["id"], r["node"]): r["step"] for r in got}
    want = {(long, long - i): i for i in range(long + 1)} | {(1000, 1000 + i): i for i in range(ring)} | {(2000, 1000 + i): i + 1 for i in range(ring)} | {(k, k): 0 for k in (2000, 3000, 9999)}
    assert len(got) == len(want) and steps == want


def test_field_defs_keep_all_lines_and_columns(spark):
    row = "size\tint\tn\t" + "\t".join(f"c{i}" for i in range(150))
    text = "\n".join(["Field Name\tData Type\tLength\tSpecial", row, *(f"more{i}" for i in range(1500))])
    got = chunks.parse_field_defs(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").collect()
    assert [r["special"] for r in got] == [" ".join([*(f"c{i}" for i in range(150)), *(f"more{i}" for i in range(1500))])]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"2024-01-01 00:{rng.randrange(60):02d}:{rng.randrange(60):02d}", rng.randrange(4)) for i in range(300)]
    df = spark.createDataFrame(rows, "event long, ts string, key int").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    later = spark.createDataFrame([(1000, "2024-01-03 00:00:00", 9), (1001, "2024-01-03 00:00:01", 9)], "event long, ts string, key int").withColumn("ts", F.col("ts").cast("timestamp"))
    cases = {
        "limited": lambda x: events.rate_limit_sliding(x, "key", "ts", "event", 5, 120),
        "windowed": lambda x: events.rate_limit_fixed(x, "key", "ts", "event", 5, 120),
        "replayed": lambda x: events.idempotent(x, ["key"], "ts", "event", 300, F.col("event") % 3 > 0),
    }
    for name, made in cases.items():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
        start = lambda made=made, stream=stream, name=name: made(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).outputMode("append").trigger(availableNow=True).start()
        start().awaitTermination()
        got = spark.read.parquet(str(tmp_path / name))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, made(df).select(*got.columns).collect()))
    # a day later the keys of the first day are forgotten
    kept = []
    for k in (1000, 1001):
        later.filter(F.col("event") == k).write.mode("append").parquet(str(tmp_path / "in"))
        q = start()
        q.awaitTermination()
        kept += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert kept[-1] == 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(1, 30), st.integers(0, 29))
def test_windows_cover_the_text(x, size, overlap):
    pieces = chunks.slide(x, size, overlap)
    assert all(0 < len(p) <= size for p in pieces) and (not x or (x.startswith(pieces[0]) and x.endswith(pieces[-1])))
    at = 0
    for p in pieces:
        at = x.index(p, max(0, at - max(overlap, 1) - size))
    assert set("".join(pieces)) == set(x)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n", max_size=200), st.integers(1, 40))
def test_packed_lines_are_the_text(x, size):
    pieces = chunks.pack_lines(x, size)
    assert "\n".join(pieces) == x and all(len(p) <= size or "\n" not in p for p in pieces)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.booleans()), max_size=25), st.integers(1, 12), st.integers(0, 5))
def test_packed_ranges(units, limit, carry):
    """Against the rule told unit by unit, with lists of atoms."""
    atoms = [(k, i) for k, (n, _) in enumerate(units) for i in range(n)]
    fresh = frozenset(k for k, (_, f) in enumerate(units) if f)
    want, held = [], []
    for k, (n, _) in enumerate(units):
        own = [(k, i) for i in range(n)]
        if held and (k in fresh or len(held) + n > limit):
            want.append(held)
            held = [] if k in fresh or not carry else held[-carry:]
        held = held + own
    want += [held] if held else []
    assert [atoms[a:b] for a, b in chunks.packed([n for n, _ in units], [1] * len(atoms), limit, carry, fresh)] == want


def test_document_chunks_are_the_text(spark, sf):
    """Without overlap the chunks hold all words once and in order, none is too long but for a single sentence; with it, each chunk may begin with the paragraph before."""
    rows = {r["doc_id"]: (r["text"] or "").replace("\n", "\n\n") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    df = spark.createDataFrame(list(rows.items()), "k long, t string")
    for overlap in (False, True):
        got: dict = {}
        for r in sorted(chunks.document_chunks(df, "k", "t", 200, overlap).collect(), key=lambda r: (r["k"], r["chunk"])):
            got.setdefault(r["k"], []).append(r["text"])
        for k, x in rows.items():
            parts = [p.strip() for p in x.split("\n\n") if p.strip()]
            if not overlap:
                assert re.sub(r"[\s.]", "", "".join(got.get(k, []))) == re.sub(r"[\s.]", "", "".join(parts))
                assert all(len(c) // 4 <= 202 + 2 * (c.count("\n\n") + c.count(". ")) or ("\n\n" not in c and ". " not in c) for c in got.get(k, []))
            for c, after in zip(got.get(k, []), got.get(k, [])[1:]):
                first = after.split("\n\n")[0]
                assert first in parts or any(first in p for p in parts)
                assert not overlap or first == c.split("\n\n")[-1] or any(len(p) // 4 > 200 and first in p for p in parts)


def test_session_chunks_hold_any_session(spark):
    rows = [(k, i, "user", "x" * (5 * (i % 9)) + str(i)) for k in (1, 2, None) for i in range(500 if k == 2 else 3)]
    got = sorted(chunks.session_chunks(spark.createDataFrame(rows, "s long, n long, r string, t string"), "s", "n", "r", "t", 20).collect(), key=lambda r: (r["s"] is None, r["s"], r["chunk"]))
    for k in (1, 2, None):
        own = [r for r in got if r["s"] == k]
        said = [f"{r}: {t}" for s, _, r, t in rows if s == k]
        assert [r["chunk"] for r in own] == list(range(len(own))) and "\n".join(r["text"] for r in own) == "\n".join(said)
        assert [r["start_idx"] for r in own] == [0, *[r["end_idx"] + 1 for r in own[:-1]]] and own[-1]["end_idx"] == len(said) - 1
        assert all(r["tokens"] == sum(len(x) // 4 for x in said[r["start_idx"] : r["end_idx"] + 1]) for r in own)


def test_each_prompt_is_asked_once_an_attempt(spark, tmp_path):
    import uuid

    from folioflow.operators import models

    def noted(name, fails):
        def make():
            def call(prompts):
                for p in prompts:
                    (tmp_path / f"{name}-{p}-{uuid.uuid4().hex}").touch()
                asked = [len(list(tmp_path.glob(f"{name}-{p}-*"))) for p in prompts]
                if any(n <= fails(p) for p, n in zip(prompts, asked)):
                    raise ValueError("not yet")
                return [name + p for p in prompts]

            return call

        return make

    df = spark.createDataFrame([(i, f"p{i}x") for i in range(14)], "n long, p string")
    # the small model fails once for every prompt, the large one always for two of them
    got = {r["p"]: (r["reply"], r["tier"], r["error"]) for r in models.tiered_map(df, "p", "n", noted("s", lambda p: 1), noted("l", lambda p: 99 if p in ("p3x", "p12x", "p13x") else 0), retries=0).collect()}
    assert len(got) == 14 and got["p1x"] == ("lp1x", "large", None) and got["p3x"] == ("sp3x", "small", None) and got["p11x"] == ("lp11x", "large", None)
    asked = lambda name, p: len(list(tmp_path.glob(f"{name}-{p}-*")))
    assert [(asked("s", p), asked("l", p)) for p in ("p1x", "p3x", "p11x", "p12x")] == [(1, 1), (2, 1), (0, 1), (1, 2)]
    assert got["p12x"] == (None, "large", "not yet")


def test_deep_json_is_flattened_to_its_leaves(spark):
    deep = '{"a":' * 60 + "7" + "}" * 60
    got = memory.flatten_json(spark.createDataFrame([(1, deep), (2, "3"), (3, '{"x":[]}')], "k int, j string"), "k", "j").collect()
    assert [(r["k"], r["path"], r["value"]) for r in got] == [(1, ".".join("a" * 60), "7")]


def test_shared_folders_are_released(spark, tmp_path):
    from folioflow.sources.shared import release, shared_folder, written

    release(spark)
    table = written(spark.range(3), "x")
    assert table.count() == 3 and release(spark) == 1
    assert not list(spark.sparkContext._jvm.java.io.File(shared_folder(spark, "y")).list() or [])
    assert release(spark) == 1


def test_positions_and_empty_tables(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (1, "a"), (2, None)], "k int, v string")
    assert [(r["k"], r["v"]) for r in records.positions(df, ["k", "v"]).orderBy("position").collect()] == [(1, "a"), (1, "b"), (2, None), (3, "a")]
    assert records.take_positions(df.limit(0), ["k"], [0]).count() == 0


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="A2"><v>1.5</v></c><c r="B2" t="b"><v>1</v></c></row></sheetData></worksheet>'
    book = {"xl/workbook.xml": '<workbook><sheets><sheet name="One"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": sheet}
    (tmp_path / "a.xlsx").write_bytes(_zip(book))
    w = 'xmlns:w="w"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>One </w:t><w:t>line</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:t>h</w:t></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:t>c</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    (tmp_path / "b.docx").write_bytes(_zip({"word/document.xml": body}))
    (tmp_path / "c.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "d.bin").write_bytes(b"x")
    (tmp_path / "e.csv").write_text('a,b\n1,"x, y"\n2\n')
    rows = files.read_xlsx_rows(spark, str(tmp_path / "*.xlsx")).collect()
    assert [(r["sheet"], r["headers"], r["cells"]) for r in rows] == [("One", ["name", "column_1", "column_2"], ["1.5", "true", ""])]
    assert files.read_docx_text(spark, str(tmp_path / "*.docx")).first()["text"] == "One line"
    assert files.read_docx_tables(spark, str(tmp_path / "*.docx")).first()["cells"] == ["c"]
    blocks, tables = files.extract_files(spark, str(tmp_path))
    assert sorted(r["text"] for r in blocks.collect()) == ["One line", "café"] and tables.count() == 4
    assert files.discover_files(spark, str(tmp_path), ["*", "*.csv"]).count() == 4
    assert [(r["a"], r["b"]) for r in files.read_csv_strings(spark, str(tmp_path / "e.csv")).collect()] == [("1", "x, y"), ("2", "")]


def test_approximate_search_finds_the_nearest(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked, all_ = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding"), rows.select(F.col("vec_id").alias("v"), "embedding")
    exact = {(r["q"], r["v"]) for r in retrieval.knn(asked, all_, "q", "v", "embedding", 10).collect()}
    near = {(r["q"], r["v"]) for r in retrieval.lsh_knn(asked, all_, "q", "v", "embedding", 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
