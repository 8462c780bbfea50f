"""Text as Column expressions: cleaning, names, keywords, fields and lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that the keyword index leaves out
INDEX_STOP_WORDS = """the a an is are was were be been being have has had do does did will would could should may might shall can need dare
ought used to of in for on with at by from as into through during before after above below between out off over under again further then
once here there when where why how all both each few more most other some such no nor not only own same so than too very just but and or
if that this these those it its i me my we our you your he him his she her they them their what which who""".split()
# fixed values: words that simple keywords leave out
SIMPLE_STOP_WORDS = """the a an is are was were be been have has had do does did will would could should may might to of in for on with at
by from as into through and or but not if that this it its""".split()
# fixed values: phrases of commands, by class
COMMANDS = {
    "add_column": ["add column", "add field", "add a column", "add a field", "create column", "create field", "new column", "new field", "insert column", "insert field"],
    "remove_column": ["remove column", "delete column", "remove field", "delete field", "drop column", "drop field"],
    "remove_rows": ["remove row", "delete row", "remove record", "delete record", "drop row", "remove where", "delete where"],
}
# fixed values: words of header lines, by kind of file
HEADER_WORDS = {
    "txt": ["name", "date", "total", "amount", "number", "id", "title", "address", "phone", "email", "invoice", "receipt", "order"],
    "docx": ["title", "name", "date", "total", "amount", "number", "id"],
    "image": ["invoice", "receipt", "date", "total", "amount", "vendor", "po", "number", "id", "name", "address", "phone", "tax"],
    "pdf": ["invoice", "date", "total", "tax", "vendor", "amount", "po", "number"],
}


def _or(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+\z", "")


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def normalize_name(x: Column) -> Column:
    """Without _ and -, lower case."""
    return F.lower(F.translate(x, "_-", ""))


def to_snake_case(x: Column) -> Column:
    """Runs of space, slash and dash are one _; other symbols go; lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"[\s/\-]+", "_"), r"[^A-Za-z0-9_]", ""))


def slug(x: Column) -> Column:
    """H21."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def quality_score(x: Column) -> Column:
    """0.2 under 50 characters, 0.5 over 5000, else 0.9."""
    return F.when(F.length(x) < 50, 0.2).when(F.length(x) > 5000, 0.5).otherwise(0.9)


def clean_text(x: Column, header: str = r"Employee\s+Timesheet\s+Report", shown: str = "Employee Timesheet Report") -> Column:
    """No page marks, a repeated header once, single spaces, at most one empty line, ASCII only, trimmed."""
    x = F.regexp_replace(x, r"(?i)Page\s+\d+\s+of\s+\d+", "")
    x = F.regexp_replace(x, rf"(?i)({header}\s*\n){{2,}}", f"{shown}\n")
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(x, r"[^\x00-\x7F]+", ""))


def apply_corrections(x: Column, table: list[tuple[str, str]], symbols: str = r"[|~^]") -> Column:
    """The literal replacements in order, then symbols and trailing garbage go."""
    for old, new in table:
        x = F.replace(x, F.lit(old), F.lit(new))
    x = F.regexp_replace(F.regexp_replace(x, symbols, ""), r"[ \t]{2,}", " ")
    return F.regexp_replace(x, r"[\s_.\-]+\z", "")


def infer_from_name(x: Column) -> Column:
    """What a field's name says of its type: struct of data_type, length_format, required."""
    low = F.lower(x)
    has = lambda *words: _or([low.contains(w) for w in words])
    made = lambda kind, form, required: F.struct(F.lit(kind).alias("data_type"), F.lit(form).alias("length_format"), F.lit(required).alias("required"))
    return (
        F.when(has("date", "time", "day"), made("date", "YYYY-MM-DD", True))
        .when(has("hours", "amount", "number", "count", "quantity"), made("numeric", "decimal(10,2)", False))
        .when(has("code", "id"), made("string", "varchar(20)", False))
        .otherwise(made("string", "varchar(255)", False))
    )


def lines(x: Column) -> Column:
    return F.split(blank(x), "\n")


def header_candidates(x: Column, kind: str = "txt") -> Column:
    """Lines that look like headers or field names, each once, 64 at most."""
    first = {"txt": 50, "docx": 20}.get(kind)
    own = lines(x)
    own = F.slice(own, 1, first) if first else own
    words = HEADER_WORDS[kind]
    found = lambda s: _or([F.lower(s).contains(w) for w in words])

    def name(s: Column) -> Column:
        s = strip(s)
        short = (s != "") & (F.length(s) < 100) if kind != "pdf" else F.lit(True)
        out = F.when(short & found(s), s)
        if kind == "txt":
            key = strip(F.split_part(s, F.lit(":"), F.lit(1)))
            out = out.when(short & (F.size(F.split(s, ":")) == 2) & (key != "") & (F.length(key) < 50), key)
        return out

    return F.slice(F.array_distinct(F.filter(F.transform(own, name), lambda s: s.isNotNull())), 1, 64)


def parse_kv(x: Column, fields: list[str]) -> Column:
    """Lines of key and value as a map from the fields. A line's key, lowered with _ for spaces, goes to the first field that contains it or that it contains; later lines win."""
    pairs = F.filter(F.transform(lines(x), lambda s: F.struct(F.lower(F.replace(strip(F.substring_index(s, ":", 1)), F.lit(" "), F.lit("_"))).alias("k"), strip(F.substring(s, F.instr(s, ":") + 1, F.length(s))).alias("v"), s.contains(":").alias("ok"))), lambda p: p["ok"] & (p["k"] != ""))

    def value(f: str, i: int) -> Column:
        low = f.lower().replace(" ", "_")
        fits = lambda p: p["k"].contains(low) | F.lit(low).contains(p["k"])
        before = [g.lower().replace(" ", "_") for g in fields[:i]]
        own = F.filter(pairs, lambda p: fits(p) & ~_or([p["k"].contains(b) | F.lit(b).contains(p["k"]) for b in before]))
        return F.try_element_at(own, F.lit(-1))["v"]

    return F.create_map(*[c for i, f in enumerate(fields) for c in (F.lit(f), value(f, i))])


def extract_field(x: Column, name: str) -> Column:
    """What follows the name and a colon or space, to the line's end; else N/A."""
    import re

    got = strip(F.regexp_extract(x, rf"(?i){re.escape(name)}[:\s]+([^\n]+)", 1))
    return F.when(got == "", "N/A").otherwise(got)


def keywords_simple(x: Column, most: int = 20) -> Column:
    """Words of letters, digits, - and _, over 2 long and no stop words, in order of first sight."""
    return F.slice(F.array_distinct(F.filter(cleaned_words(x), lambda w: (F.length(w) > 2) & ~w.isin(SIMPLE_STOP_WORDS))), 1, most)


def cleaned(x: Column) -> Column:
    """A text, lowered, of letters, digits, _, - and white space alone."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s\-]", "")


def cleaned_words(x: Column) -> Column:
    """The words of a cleaned text."""
    return F.split(cleaned(x), r"\s+")


def is_keyword(word: Column) -> Column:
    """Whether the index takes a cleaned word: 2 bytes or more, no stop word."""
    return (F.octet_length(word) >= 2) & ~word.isin(INDEX_STOP_WORDS)


def keyword_tokens(x: Column) -> Column:
    """The index's words, with repeats."""
    return F.filter(cleaned_words(x), is_keyword)


def classify_command(x: Column) -> Column:
    """The first class of which a phrase is in the command, else update_values."""
    out = None
    for name, phrases in COMMANDS.items():
        hit = F.lower(x).rlike("|".join(phrases))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("update_values")


def detect_type(x: Column, patterns: dict[str, list[str]]) -> Column:
    """The type with the most keywords in the text, the first on ties, null without any."""
    low = F.lower(x)
    scores = [F.struct(_sum([low.contains(k.lower()).cast("int") for k in ks]).alias("score"), F.lit(-i).alias("rank"), F.lit(t).alias("name")) for i, (t, ks) in enumerate(patterns.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, best["name"])


def keyword_score(x: Column, fields: list[str]) -> Column:
    """How many of the words (over 2 characters) of the first 15 fields are in the text."""
    words = [w for f in fields[:15] for w in f.lower().replace("_", " ").split() if len(w) > 2]
    return _sum([F.lower(x).contains(w).cast("int") for w in words])


def extract_form_fields(x: Column, most: int = 50) -> Column:
    """Labels before blanks or colons, then the cells of a table's header lines; each once."""
    patterns = [r"([A-Z][A-Za-z\s]+):\s*[_\-]{2,}", r"([A-Z][A-Za-z\s]+)\s+[_\-]{3,}", r"\*?\s*([A-Z][A-Za-z\s]+)\s*:"]
    labels = F.concat(*[F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(1)), strip) for p in patterns])
    labels = F.filter(labels, lambda s: F.length(s) > 2)
    cells = F.transform(F.regexp_extract_all(x, F.lit(r"(?m)^[ \t]*\|[ \t]*(.+?)[ \t]*\|"), F.lit(1)), strip)
    return F.slice(F.array_distinct(F.concat(labels, F.filter(cells, lambda s: s != ""))), 1, most)


def count_tokens(x: Column) -> Column:
    """Characters div 4."""
    return F.floor(F.length(x) / 4).cast("long")


def token_budget(rows: Column, fields: Column) -> Column:
    """(rows * fields * 15 + 300) * 1.3, within 3000 and 8192."""
    return F.least(F.lit(8192), F.greatest(F.lit(3000), F.floor((rows * fields * 15 + 300) * 1.3))).cast("long")


def needs_chunking(rows: Column, fields: Column) -> Column:
    return (fields * 100 * rows / 4 > 7000) | (rows > 20)


def field_card(name: Column, kind: Column, notes: Column) -> Column:
    """A field in a line."""
    return F.concat_ws(" | ", F.concat(F.lit("Field: "), name), F.concat(F.lit("Type: "), kind), F.concat(F.lit("Notes: "), notes))


def pick_label(x: Column, labels: list[str]) -> Column:
    """The first label in the reply, else the first label."""
    low, out = F.lower(x), None
    for label in labels:
        hit = low.contains(label.lower())
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(labels[0])


def clamp01(x: Column) -> Column:
    """H46."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def name_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.85 if one contains the other, else common prefix and suffix by the longer length, at most 1; of normalized names. Null with a null name."""
    a, b = normalize_name(a), normalize_name(b)
    short = F.least(F.length(a), F.length(b))

    def common(x: Column, y: Column) -> Column:
        places = F.when(short > 0, F.sequence(F.lit(1), short)).otherwise(F.array().cast("array<int>"))
        differ = F.filter(places, lambda i: F.substr(x, i, F.lit(1)) != F.substr(y, i, F.lit(1)))
        return F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, short)

    most = F.greatest(F.length(a), F.length(b))
    part = F.least(F.lit(1.0), (common(a, b) + common(F.reverse(a), F.reverse(b))) / F.greatest(most, F.lit(1)))
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.85).when(a.isNotNull() & b.isNotNull(), part)
