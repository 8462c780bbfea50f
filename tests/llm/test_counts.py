"""Language, contamination, quality and sharding against brute force, and on rows that are odd."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import contamination, language, quality, queries, sharding

ODD = [(1, None, "en"), (2, "", None), (3, "  \n\t ", "en"), (None, "the and of", "en"), (5, "1234 !! 5", "fr"), (6, "the and of " * 3000, "en"), (6, "the and of " * 3000, "en"), (7, "été \U0001f600 \x00 ou", "fr")]


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 5) for r in ODD], "doc_id long, text string, lang string, score int")


def test_language_held_out(spark, sf, docs):
    rows = queries.op1_language(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) for r in rows)
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"]]
    assert np.mean(right) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_mixture(text: str, langs: list[str], table: np.ndarray, rounds: int = 8, penalty: float = 2.0) -> dict[str, float]:
    """The chosen set and its proportions, by the definitions, a word at a time; empty without a letter."""
    low = "".join(x.lower() for x in text).encode()
    words = re.findall(rb"[a-z\x80-\xff]+", low)
    if not words or not re.search(r"[^\W\d_]", text):
        return {}
    like = []
    for w in words:
        x = b" " + w + b" "
        grams = [x[i] << 16 | x[i + 1] << 8 | x[i + 2] for i in range(len(w))]
        e = sum(table[:, (g * 2654435761 % 2**32) >> 16].astype(float) for g in grams) / 3
        like.append(np.exp(np.maximum(e - e.max(), -40)))

    def em(allowed):
        share = {k: 1 / len(allowed) for k in allowed}
        for _ in range(rounds):
            total = dict.fromkeys(allowed, 0.0)
            for e in like:
                mass = sum(share[k] * e[k] for k in allowed)
                for k in allowed:
                    total[k] += share[k] * e[k] / (mass + 1e-30)
            share = {k: v / len(like) for k, v in total.items()}
        return share, sum(np.log(sum(share[k] * e[k] for k in allowed) + 1e-30) for e in like)

    alone = [sum(np.log(e[k] + 1e-30) for e in like) for k in range(len(langs))]
    best, gain = {int(np.argmax(alone)): 1.0}, max(alone)
    full, _ = em(range(len(langs)))
    order = sorted(full, key=lambda k: (-full[k], k))
    for n in range(2, len(langs) + 1):
        share, fit = em(order[:n])
        if fit - penalty * (n - 1) * np.log(len(like) + 1) > gain:
            best, gain = share, fit - penalty * (n - 1) * np.log(len(like) + 1)
    return {langs[k]: v for k, v in best.items() if v > 0}


def test_language_equals_plain_expectation_maximisation(spark, sf, docs):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    langs, table = language.train(rows, F.col("text"), F.col("lang"), F.col("doc_id"))
    some = [(k, r["text"]) for k, r in docs.items() if r["text"] and len(r["text"]) < 2500][:120]
    some += [(10**6 + i, f"{a[1][:400]} {b[1][:300]} {c[1][:200]}") for i, (a, b, c) in enumerate(zip(some, some[7:], some[31:]))][:40]
    got = language.identify(spark.createDataFrame(some, "k long, t string"), F.col("t"), langs, table).collect()
    several = 0
    for r in got:
        want = plain_mixture(r["t"], langs, table)
        several += len(want) > 1
        assert set(r["langs"]) == set(want) and r["lang_pred"] == max(want, key=want.get)
        np.testing.assert_allclose(r["shares"], [want[x] for x in r["langs"]], atol=2e-3)
    assert several > 10
    with pytest.raises(ValueError):
        language.train(rows, F.col("text"), F.col("lang"), F.col("doc_id"), most_langs=2)


def test_language_mixture_and_odd_rows(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs, table = language.train(docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    texts = {r["lang"]: r["text"] for r in docs.filter("n_chars between 600 and 4000 and not text rlike '[#|!$]'").collect()}
    mixed = spark.createDataFrame([(1, texts["en"][:600] + "\n" + texts["de"][:300])], "id long, text string")
    row = language.identify(mixed, F.col("text"), langs, table).first()
    assert set(row["langs"]) == {"en", "de"} and row["lang_pred"] == "en" and 0.5 < row["score"] < 0.85
    got = language.identify(odd, F.col("text"), langs, table).collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "en", "und", "en", "en", "fr"]
    assert got[0]["score"] == 0 and got[0]["langs"] == []
    assert language.identify(odd.limit(0), F.col("text"), langs, table).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, F.col("text"), [], np.zeros((0, language.BUCKETS), np.float32)).collect()} == {"und"}


def test_language_sets_may_hold_all_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs, table = language.train(docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    texts = {r["lang"]: r["text"][:600] for r in docs.filter("n_chars between 600 and 4000 and not text rlike '[#|!$]'").collect()}
    assert len(langs) == 4 and set(texts) == set(langs)
    row = language.identify(spark.createDataFrame([(1, "\n".join(texts.values()))], "id long, text string"), F.col("text"), langs, table).first()
    assert set(row["langs"]) == set(langs) and row["score"] < 0.4


def brute_contamination(texts: dict, items: list) -> dict:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    windows: dict = {}
    for item, text in items:
        w = word.findall(lower(text)) if item is not None and text is not None else []
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = {}
    for key, text in texts.items():
        w = word.findall(lower(text or ""))
        hit, found = set(), set()
        for size in {len(g) for g in windows}:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[g]
        out[key] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination_equals_brute_force(spark, sf, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute_contamination({k: r["text"] for k, r in docs.items()}, items)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in queries.op3_decontamination(spark, sf).collect()}
    assert got == want and sum(x[4] for x in want.values()) > 0


def test_contamination_short_items_blocks_and_odd_rows(spark, odd):
    items = [("a", "The AND of"), ("b", "of the"), ("c", None), (None, "the and"), ("d", ""), ("e", "Été"), ("e", "été"), ("f", " ".join(str(i) for i in range(30)))]
    bench = spark.createDataFrame(items, "id string, text string")
    texts = {i: r[1] for i, r in enumerate(ODD)} | {20: " ".join(str(i) for i in range(2, 18)), 21: "of. THE and-of"}
    df = spark.createDataFrame(list(texts.items()), "k long, text string")
    want = brute_contamination(texts, items)
    for size in (8 << 20, 0):  # by broadcast, and by join
        got = contamination.scan(df.withColumns({"hits": F.lit(1), "N_Words": F.lit(2), "__text": F.lit(3)}), F.col("text"), bench, F.col("id"), F.col("text"), broadcast_bytes=size)
        assert sorted(got.columns) == ["__text", "hits", "items", "k", "n_words", "text"]
        hit = contamination.n_hit(F.col("hits"))
        rows = {r["k"]: (r["n_words"], r["h"], len(r["items"]), contamination.items_digest(r["items"]), r["c"]) for r in got.withColumns({"h": hit, "c": contamination.contaminated(F.col("n_words"), hit)}).collect()}
        assert rows == want
    assert contamination.scan(df, F.col("text"), bench.limit(0), F.col("id"), F.col("text")).filter("size(hits) > 0").count() == 0
    assert contamination.scan(df.limit(0), F.col("text"), bench, F.col("id"), F.col("text"), broadcast_bytes=0).count() == 0
    assert contamination.scan(df, F.col("text"), bench.limit(0), F.col("id"), F.col("text"), broadcast_bytes=-1).filter("size(hits) > 0").count() == 0
    cleaned = contamination.remove_spans(contamination.scan(df, F.col("text"), bench, F.col("id"), F.col("text")), F.col("text")).filter("k = 20").first()["cleaned"]
    assert cleaned == ""


def test_contamination_by_join_equals_that_by_broadcast(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    rows = [sorted(map(str, contamination.scan(docs.select("doc_id", "text"), F.col("text"), bench, F.col("item_id"), F.col("text"), broadcast_bytes=n).drop("text").collect())) for n in (8 << 20, 0)]
    assert rows[0] == rows[1] and any("first=" in x for x in rows[0])


def brute_quality(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeat = {i + k for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for k in range(8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), len(words) < 20 or 100 * len(repeat) > 30 * len(words)


def test_quality_counts_equal_brute_force(spark, sf, docs, odd):
    rows = queries.op7_quality(spark, sf).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in rows:
        assert tuple(r[k] for k in names) == brute_quality(docs[r["doc_id"]]["text"]), r["doc_id"]
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    kept = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in rows}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [kept[k][0] for k, v in labels.items() if v == 1 and not kept[k][1]]
    bad = [kept[k][0] for k, v in labels.items() if v == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05
    got = quality.assess(odd, F.col("text"), None).collect()
    assert [tuple(r[k] for k in names) for r in got] == [brute_quality(r[1]) for r in ODD]


def test_quality_of_empty_tables_and_clashing_names(spark, sf, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert quality.train(docs.limit(0), labels, F.col("text"), "doc_id", "quality") is None
    assert quality.train(docs, labels.limit(0), F.col("text"), "doc_id", "quality") is None
    model = quality.train(docs, labels, F.col("text"), "doc_id", "quality")
    assert quality.assess(docs.limit(0), F.col("text"), model).count() == 0
    got = quality.assess(odd.withColumns({"Kept": F.lit("x"), "n_words": F.lit("y")}), F.col("text"), model)
    assert sorted(got.columns) == sorted(["doc_id", "text", "lang", "score", *quality.FIELDS.names])
    rows = got.collect()
    assert [r["n_words"] for r in rows] == [brute_quality(r["text"])[0] for r in rows]
    same = [tuple(r[c] for c in quality.FIELDS.names) for r in rows if r["doc_id"] == 6]
    assert len(same) == 2 and same[0] == same[1]


def test_lines_are_labelled_within_texts(spark, sf):
    """Boilerplate put between the lines of good texts is found, and the good lines around it are left."""
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels, F.col("text"), "doc_id", "quality")
    junk = ["Home | News | Shop | Login | Help | Terms | Contact | About", "BUY!! NOW!! CHEAP!! BEST!! OFFER!! TODAY!! ONLY!! HERE!!", "go*** on*** the$$$ big### win&&& of%%% it*** all###", "click here | click here | click here | click here |"]
    good = [r["text"] for r in docs.join(labels.filter("quality = 1"), "doc_id").filter("text not rlike '[|#$]' and length(text) > 800").select("text").collect() if r["text"].count("\n") >= 4]
    texts, of = [], []
    for k, x in enumerate(good):
        lines = [y for y in x.split("\n") if y.split()]
        at = len(lines) // 2
        texts.append("\n".join([*lines[:at], *junk, *lines[at:]]).encode())
        of.append([0] * at + [1] * len(junk) + [0] * (len(lines) - at))
    found = quality.Texts(texts)
    state = quality.viterbi(quality._scores(found.features, model[0]), model[1], found.line_doc)
    bad = np.concatenate(of) == 1
    assert len(good) > 50 and len(bad) == len(state)
    assert state[bad].mean() < 0.05 and state[~bad].mean() > 0.95
    part = quality.assess(spark.createDataFrame([(x.decode(),) for x in texts], "text string"), F.col("text"), model).collect()
    assert np.mean([0 < r["content_share"] < 1 for r in part]) > 0.9


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    doc = np.repeat([0, 1, 2], [4, 1, 6])
    score, move = rng.normal(size=(11, 2)), rng.normal(size=(2, 2))
    got = quality.viterbi(score, move, doc)
    for d in range(3):
        own = np.flatnonzero(doc == d)
        best = max(range(2 ** len(own)), key=lambda m: sum(score[i, m >> k & 1] for k, i in enumerate(own)) + sum(move[m >> k & 1, m >> k + 1 & 1] for k in range(len(own) - 1)))
        assert [best >> k & 1 for k in range(len(own))] == got[own].tolist()


def check_shards(rows, shards):
    for s in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_sharding(spark, sf, docs):
    rows = queries.op10_sharding(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    where = {}
    for r in rows:
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert where.setdefault(raw, r["shard"]) == r["shard"]
    check_shards(rows, 16)
    sums = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(16)]
    assert max(sums) - min(sums) <= 50


def plain_differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """The members of each way, by the rule told with lists: the two partial partitions of largest spread, again and again."""
    parts = [(k, [(x, [k])] + [(0, []) for _ in range(ways - 1)]) for k, x in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[1][-1][0] - p[1][0][0], p[0]))
        (_, a), (_, b) = parts[:2]
        both = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]
        parts = [*parts[2:], (made, sorted(both, key=lambda v: -v[0]))]
        made += 1
    return [members for _, members in parts[0][1]]


def test_sharding_equals_plain_differencing(spark, sf, docs):
    rows = queries.op10_sharding(spark, sf).collect()
    size: dict[bytes, int] = Counter()
    for r in docs.values():
        size[(r["text"] or "").encode()] += len((r["text"] or "").encode()) + 1
    order = sorted(size, key=lambda x: (-size[x], hashlib.sha256(x).digest()))
    want = {frozenset(order[k] for k in members) for members in plain_differencing([size[x] for x in order], 16)}
    got = {frozenset((docs[r["doc_id"]]["text"] or "").encode() for r in rows if r["shard"] == s) for s in range(16)}
    assert got == want


def test_sharding_spreads_a_hot_key(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("k"), F.col("id").cast("string").alias("slot"), F.lit(1).alias("shard"))
    rows = sharding.shard(df, F.col("slot"), F.col("k"), 4).collect()
    assert len(rows) == 3000
    check_shards(rows, 4)


def test_sharding_odd_rows_and_differencing(spark, odd):
    rows = sharding.shard(odd, F.col("text"), F.col("doc_id"), 3).collect()
    assert len(rows) == len(ODD)
    check_shards(rows, 3)
    assert sharding.shard(odd.limit(0), F.col("text"), F.col("doc_id"), 3).count() == 0
    sums, to = sharding.difference([(8,), (7,), (6,), (5,), (4,)], 2)
    assert sorted(sums) == [14, 16] and sum(x for x, t in zip((8, 7, 6, 5, 4), to) if t[0] == 0) == sums[0]
    rng = np.random.default_rng(1)
    parts = [tuple(rng.integers(0, 1000, 4).tolist()) for _ in range(200)]
    sums, to = sharding.difference(parts, 4)
    assert max(sums) - min(sums) <= 3 and all(sorted(t) == [0, 1, 2, 3] for t in to)
    assert list(sums) == [sum(p[k] for p, t in zip(parts, to) for k in range(4) if t[k] == w) for w in range(4)]


def test_sharding_keeps_balance_above_the_groups_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_A_TASK", 500)
    rng = np.random.default_rng(4)
    small = rng.integers(100, 3000, 6000).tolist()
    sizes = [*small, int(sum(small) * 0.055 / 0.945)]
    groups = spark.createDataFrame([(str(i).encode(), x) for i, x in enumerate(sizes)], "g binary, bytes long")
    where, sums = sharding.assign(groups, 16)
    got = {int(r["g"]): r["shard"] for r in where.collect()}
    assert sorted(got) == list(range(len(sizes)))
    assert sums == [sum(x for i, x in enumerate(sizes) if got[i] == s) for s in range(16)]
    assert max(sums) * 16 / sum(sizes) < 1.001


def test_rows_that_repeat_are_dealt_over_many_tasks(spark):
    rows = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"), F.col("id").alias("extra")).repartition(8)
    out = sharding.shard(rows, F.col("text"), F.col("doc_id"), 4)
    slots = sorted(r["slot"] for r in out.collect())
    assert slots == list(range(60_000)) and out.select("shard").distinct().count() == 1
    import public_tokenizers

    from folioflow.llm import bpe, records

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one partition else
    manifest = records.write(rows, F.col("text"), F.col("doc_id"), bpe.load(public_tokenizers.path("byte_bpe_50k.json")), end=2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 4 and manifest.agg(F.max("docs")).first()[0] < 30_000
    assert records.read(manifest).agg(F.count("*"), F.countDistinct("start"), F.max("start")).first()[:] == (60_000, 60_000, 59_999)
    none = records.write(rows.limit(0), F.col("text"), F.col("doc_id"), bpe.load(public_tokenizers.path("byte_bpe_50k.json")), end=2)
    assert records.read(none).count() == 0
