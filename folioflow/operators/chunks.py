"""Cutting texts into chunks (I1-I6, I8-I12) and pages into sections.

Packing is greedy: where a chunk ends depends on all units before it. Those packers run over Arrow batches, each text
by itself; nothing is gathered. The helpers between the Spark calls see one text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.batches import arrow_types, same, spread, with_columns
from folioflow.functions.text import blank, clean_text, quality_score, strip
from folioflow.operators.automaton import Automaton

#: Bytes of text that a task cuts at once.
CUT = 1 << 20

def _cut(df: DataFrame, key: str, text: str, cut: Callable[[str], list[str]]) -> DataFrame:
    """(key, chunk, text): the pieces of each text, numbered from 0. Keys of any type pass as they are, nulls too."""
    rows = df.select(F.col(key).alias("key"), blank(F.col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole, whole.column(1)):
                pieces = [cut(x) for x in b.column(1).to_pylist()]
                row = [i for i, p in enumerate(pieces) for _ in p]
                chunk = [i for p in pieces for i in range(len(p))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(chunk, pa.int64()), pa.array([x for p in pieces for x in p], pa.string())], names=["key", "chunk", "text"])

    schema = T.StructType([rows.schema["key"], T.StructField("chunk", T.LongType()), T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _parts(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have CUT bytes together; a longer text is a run of its own."""
    past = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64)
    i = 0
    while i < batch.num_rows:
        end = max(i + 1, int(np.searchsorted(past, (past[i - 1] if i else 0) + CUT, "right")))
        yield batch.slice(i, end - i)
        i = end


def _paragraphs(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]


def split_paragraphs(df: DataFrame, key: str, text: Column) -> DataFrame:
    """The trimmed parts between empty lines."""
    parts = F.filter(F.transform(F.split(blank(text), r"\n\s*\n"), strip), lambda p: p != "")
    return df.select(key, F.posexplode(parts).alias("chunk", "text"))


def packed(units: list[int], weights: list[int], limit: int, carry: int = 0, fresh: frozenset[int] = frozenset(), again: list[int] | None = None) -> list[tuple[int, int]]:
    """Ranges of atoms, chunk after chunk, so that a chunk's weight stays within the limit where its units allow.

    A unit is so many atoms, which stay together. A chunk that is full hands its last carry atoms on to the next, where
    they weigh what again says; a fresh unit begins a chunk in any case and is handed nothing.
    """
    ranges, first, past, held = [], 0, 0, 0
    for k, atoms in enumerate(units):
        weight = sum(weights[past : past + atoms])
        if past > first and (k in fresh or held + weight > limit):
            ranges.append((first, past))
            first = past if k in fresh else max(first, past - carry)
            held = sum((again or weights)[first:past])
        past, held = past + atoms, held + weight
    return [*ranges, (first, past)] if past > first else ranges


def _word_packs(text: str, target: int, overlap: int) -> list[str]:
    paragraphs = [p.split() for p in _paragraphs(text)]
    words = [w for p in paragraphs for w in p]
    return [" ".join(words[a:b]) for a, b in packed([len(p) for p in paragraphs], [1] * len(words), target, overlap)]


def word_chunks(df: DataFrame, key: str, text: str, target: int = 512, overlap: int = 50) -> DataFrame:
    """Paragraphs packed to so many words; none is cut; the last words are carried over."""
    return _cut(df, key, text, lambda x: _word_packs(x, target, overlap))


def slide(text: str, size: int, overlap: int) -> list[str]:
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            space = max(text.rfind(c, start, end) for c in " \n\t")
            if space > start:
                end = space + 1
        out.append(text[start:end])
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def char_chunks(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """Windows of code points that end behind the last white space and overlap; the last ends the text."""
    return _cut(df, key, text, lambda x: slide(x, size, overlap))


def pack_lines(text: str, size: int, carry: int = 0) -> list[str]:
    if len(text) <= size:
        return [text] if text else []
    own = text.split("\n")
    return ["\n".join(own[a:b]) for a, b in packed([1] * len(own), [len(x) + 1 for x in own], size, carry)]


def line_chunks(df: DataFrame, key: str, text: str, size: int = 3000, carry: int = 0) -> DataFrame:
    """Lines packed to so many characters, with the last lines of a chunk again in the next; a short text whole, an empty one none."""
    return _cut(df, key, text, lambda x: pack_lines(x, size, carry))


def page_chunks(df: DataFrame, key: str, text: Column, n: int = 2, sep: str = "\n\n---PAGE BREAK---\n\n") -> DataFrame:
    """Texts cut at page marks or form feeds, n pages in a chunk."""
    pages = F.filter(F.transform(F.split(blank(text), r"\n\s*Page \d+\s*\n|\n\s*-+\s*\d+\s*-+\s*\n|\f"), strip), lambda p: p != "")
    starts = F.when(F.size("pages") > 0, F.sequence(F.lit(1), F.size("pages"), F.lit(n))).otherwise(F.array().cast("array<int>"))
    return df.select(key, pages.alias("pages")).select(key, F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("pages", i, n), sep))).alias("chunk", "text"))


def session_chunks(df: DataFrame, session: str, turn: str, role: str, text: str, max_tokens: int = 800) -> DataFrame:
    """I8: the messages of each session packed in order to so many tokens (characters div 4): chunk, start_idx, end_idx, tokens, text.

    Where a chunk ends depends on all messages before it, so a session is packed by one task; Spark sorts its messages,
    and only the open chunk is in memory.
    """
    said = F.concat(F.coalesce(role, F.lit("user")), F.lit(": "), F.coalesce(text, F.lit("")))
    rows = df.select(F.col(session).alias("key"), F.col(turn).alias("turn"), said.alias("said"))
    names = ["key", "chunk", "start_idx", "end_idx", "tokens", "text"]
    schema = T.StructType([rows.schema["key"], *[T.StructField(n, T.LongType()) for n in names[1:5]], T.StructField("text", T.StringType())])
    types = arrow_types(schema)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk, start, tokens = None, 0, 0, 0
        held: list[str] = []
        for b in batches:
            out = []
            for key, s in zip(b.column("key").to_pylist(), b.column("said").to_pylist(), strict=True):
                other = held and not same(key, own)
                if other or (held and tokens + len(s) // 4 > max_tokens):
                    out.append((own, chunk, start, start + len(held) - 1, tokens, "\n".join(held)))
                    chunk, start = (0, 0) if other else (chunk + 1, start + len(held))
                    held, tokens = [], 0
                own, tokens = key, tokens + len(s) // 4
                held.append(s)
            if out:
                yield made(out)
        if held:
            yield made([(own, chunk, start, start + len(held) - 1, tokens, "\n".join(held))])

    dealt = rows.repartition("key").sortWithinPartitions("key", "turn", "said")
    return dealt.mapInArrow(run, schema).withColumnRenamed("key", session)


def _document_packs(text: str, max_tokens: int, overlap: bool) -> list[str]:
    """Paragraphs are units; of one that is too long, runs of its sentences are, each of which begins a chunk."""
    units: list[str] = []
    weights: list[int] = []
    fresh = set()
    for p in filter(None, map(str.strip, text.split("\n\n"))):
        if len(p) // 4 <= max_tokens:
            units.append(p)
            weights.append(len(p) // 4)
            continue
        sentences = p.split(". ")
        sizes = [len(s) // 4 for s in sentences]
        for a, b in packed([1] * len(sizes), sizes, max_tokens):
            fresh.add(len(units))
            units.append(". ".join(sentences[a:b]))
            weights.append(sum(sizes[a:b]))
    ranges = packed([1] * len(units), weights, max_tokens, int(overlap), frozenset(fresh), [len(u) // 4 for u in units])
    return ["\n\n".join(units[a:b]) for a, b in ranges]


def document_chunks(df: DataFrame, key: str, text: str, max_tokens: int = 800, overlap: bool = True) -> DataFrame:
    """Paragraphs packed to so many tokens, long ones cut at `. `, the last paragraph carried over."""
    return _cut(df, key, text, lambda x: _document_packs(x, max_tokens, overlap))


def atomic_records(df: DataFrame, key: str, text: str, marker: str = r"(?:employee|emp|id|number|#)\s*:?\s*[A-Z0-9\-]{3,15}", size: int = 2500, least: int = 50) -> DataFrame:
    """Cleaned texts cut from marker to marker where there are over 5, else at double empty lines; slices where that gives under 3 pieces of over least characters.

    Cuts are marked by a character beyond ASCII, which cleaned texts don't have.
    """
    cut, clean = "\uffff", F.col("clean")
    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("key", clean_text(blank(F.col("text"))).alias("clean"))
    # a step a select: what is used twice is found once, and not again for each slice
    rows = rows.select("key", "clean", F.split(F.regexp_replace(clean, f"(?i)({marker})", f"{cut}$1"), cut).alias("marked"))
    pieces = F.when(F.size("marked") > 6, F.slice("marked", 2, F.size("marked"))).otherwise(F.split(clean, r"\n\s*\n\s*\n"))
    rows = rows.select("key", "clean", F.filter(F.transform(pieces, strip), lambda p: F.length(p) > least).alias("pieces"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(clean), F.lit(1)), F.lit(size))
    slices = F.filter(F.transform(starts, lambda i: strip(F.substr(clean, i, F.lit(size)))), lambda s: s != "")
    return rows.select(F.col("key").alias(key), F.posexplode(F.when(F.size("pieces") >= 3, F.col("pieces")).otherwise(slices)).alias("chunk", "text"))


def fixed_slices(df: DataFrame, key: str, text: Column, size: int) -> DataFrame:
    """Slices of so many characters, trimmed, without empty ones."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(blank(text)), F.lit(1)), F.lit(size))
    return df.select(key, F.posexplode(F.filter(F.transform(starts, lambda i: strip(F.substr(blank(text), i, F.lit(size)))), lambda s: s != "")).alias("chunk", "text"))


def ingest_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Word chunks with digest, running begin and end in characters, quality and id."""
    chunks = word_chunks(df, key, text).withColumn("end", F.sum(F.length("text")).over(Window.partitionBy(key).orderBy("chunk")))
    return chunks.select(
        F.concat_ws("-", F.col(key).cast("string"), F.col("chunk").cast("string")).alias("id"), key, "chunk", (F.col("end") - F.length("text")).alias("start"), "end", F.sha2("text", 256).alias("chunk_hash"), quality_score(F.col("text")).alias("quality"), "text"
    )


def sections_by_type(pages: DataFrame, file: str, page: str, kind: str) -> DataFrame:
    """Runs of pages of one type; pages without a type go with those before: file, section, kind, first, last."""
    w = Window.partitionBy(file).orderBy(page)
    filled = pages.select(file, page, F.last(kind, ignorenulls=True).over(w).alias("kind")).filter("kind is not null")
    new = (F.lag("kind").over(w).isNull() | (F.lag("kind").over(w) != F.col("kind"))).cast("int")
    return filled.withColumn("new", new).withColumn("section", F.sum("new").over(w)).groupBy(file, "section", "kind").agg(F.min(page).alias("first"), F.max(page).alias("last"))


def sections_by_anchor(marks: DataFrame, file: str, page: str, n_pages: str) -> DataFrame:
    """From each mark to the page before the next mark, or to the end; empty sections go."""
    nxt = F.lead(page).over(Window.partitionBy(file).orderBy(page, "anchor"))
    return marks.select(file, "anchor", F.col(page).alias("first"), F.coalesce(nxt - 1, F.col(n_pages)).alias("last")).filter("last >= first")


def match_anchors(pages: DataFrame, anchors: DataFrame, text: str, most_bytes: int = 16 << 20) -> DataFrame:
    """Pages with the templates (name, anchor) of which an anchor is in the text, in any case; an empty anchor is in every text.

    The anchors and names may have so many bytes together, which is checked before they are collected; an automaton
    finds all of them in one pass over a batch's texts. Null anchors, names and texts match nothing.
    """
    given = anchors.select("name", F.lower("anchor").alias("anchor")).dropna()
    size = given.agg(F.sum(F.octet_length("name") + F.octet_length("anchor"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"over {most_bytes} bytes of anchors: use a keyword index and join on words")
    names: dict[str, set[str]] = {}
    for r in given.distinct().collect():
        names.setdefault(r["anchor"], set()).add(r["name"])
    always = sorted(names.pop("", ()))
    strings = sorted(names)
    every = sorted({n for own in names.values() for n in own}.union(always))
    code = {n: i for i, n in enumerate(every)}
    own = [np.array(sorted(code[n] for n in names[x]), np.int64) for x in strings]
    count = np.array([len(x) for x in own], np.int64)
    held = pages.sparkSession.sparkContext.broadcast((Automaton([x.encode() for x in strings]), np.cumsum(count) - count, count, np.concatenate([*own, np.zeros(0, np.int64)]), [code[n] for n in always], every))
    low = "__low"

    def start() -> Callable[[pa.RecordBatch], list]:
        automaton, first, count, flat, always, every = held.value
        shown = pa.array(every, pa.string())

        def found(b: pa.RecordBatch) -> list:
            texts = [None if x is None else x.encode() for x in b.column(b.num_columns - 1).to_pylist()]
            text, string = automaton.find([x or b"" for x in texts])
            n = count[string]
            code = flat[np.arange(int(n.sum())) + np.repeat(first[string] - np.cumsum(n) + n, n)]
            there = np.array([i for i, x in enumerate(texts) if x is not None], np.int64)
            pair = np.concatenate([np.repeat(text, n) * len(every) + code, *[there * len(every) + c for c in always]])
            text, code = np.divmod(np.unique(pair), max(1, len(every)))
            at = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(at), shown.take(pa.array(code)))]

        return found

    made = with_columns(pages.withColumn(low, F.lower(text)), start, [T.StructField("name", T.ArrayType(T.StringType()))])
    return made.drop(low).withColumn("name", F.explode("name"))


def parse_field_defs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of field tables below a header line: key, name, data_type, length_format, special, required, allowed.

    Columns are parted by tabs or two spaces. A line of three columns, or of two behind an empty line, begins a field;
    others go on with the field before. A line in capitals ends a table.
    """
    header = r"(?i)field\s*name.*data\s*type.*(length|format).*(special|notes|instruction)"
    rows = df.select(key, F.posexplode(F.split(blank(F.col(text)), "\n")).alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i")
    cols = F.filter(F.transform(F.split(strip(F.col("line")), r"\t+| {2,}"), lambda c: F.trim(c)), lambda c: c != "")
    stop = F.col("line").rlike(r"^[A-Z][A-Z0-9\s/\-]{0,80}$")
    rows = rows.withColumn("cols", cols).withColumn("state", F.when(F.col("line").rlike(header), 1).when(stop, 0))
    rows = rows.withColumn("inside", F.last("state", ignorenulls=True).over(w)).filter("inside = 1 and state is null")
    blank_before = F.trim(F.lag("line").over(w)) == ""
    starts = (F.size("cols") >= 3) | ((F.size("cols") >= 2) & F.coalesce(blank_before | F.lag("line").over(w).isNull(), F.lit(True)))
    rows = rows.withColumn("new", starts.cast("int")).withColumn("field", F.sum("new").over(w)).filter("field > 0 and trim(line) <> ''")
    made = rows.groupBy(key, "field").agg(F.array_sort(F.collect_list(F.struct("i", "line", "cols"))).alias("r"))
    first = F.col("r")[0]["cols"]
    special = F.trim(F.concat_ws(" ", F.array_join(F.slice(first, 4, F.size(first)), " "), F.array_join(F.transform(F.slice("r", 2, F.size("r")), lambda x: F.trim(x["line"])), " ")))
    return made.select(
        key,
        first[0].alias("name"),
        F.get(first, F.lit(1)).alias("data_type"),
        F.coalesce(F.get(first, F.lit(2)), F.lit("")).alias("length_format"),
        special.alias("special"),
        F.when(F.array_join(first, " ").rlike(r"(?i)\b(required|mandatory)\b"), True).when(F.array_join(first, " ").rlike(r"(?i)\boptional\b"), False).alias("required"),
        F.filter(F.transform(F.split(F.regexp_extract(F.array_join(F.slice(first, 4, F.size(first)), " "), r"(?i)(?:allowed|valid|values?)\s*:\s*(.+)", 1), "[,;|]"), strip), lambda v: v != "").alias("allowed"),
    )
