"""Phrases against counting by definition, and the transforms' intervals against the text."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioflow.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest, share, most=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            lang = "und" if lang is None else lang
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    out = []
    for (lang, w), a in found.items():
        if 100 * longer[lang, w] >= share * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), len(w), a, f[lang, w[:k]], f[lang, w[k:]], score, n[lang]))
    return set(out)


def mined(spark, rows, least=3, longest=4, share=80, parts=3, **options):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(parts)
    found, totals = phrases.mine(df, F.col("text"), F.col("lang"), least, longest, share, **options)
    got = found.join(totals, "lang").select("lang", "phrase", "words", "a", "l", "r", "score", "n").collect()
    assert len(got) == len({(r.lang, r.phrase) for r in got})
    return {tuple(r) for r in got}


def some_rows(seed, n):
    rnd = random.Random(seed)
    words = ["A", "b", "the", "of", "été", "x y", "日本", "z" * 40, "AB", "\u0000"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!"]) for _ in range(rnd.randrange(60)))
    return [(text(), rnd.choice(["en", "fr", None, "und", ""])) for _ in range(n)]


def test_equals_counting(spark):
    rows = some_rows(1, 400) + [(None, "en"), ("", "en"), (" . ,\n", "xx"), (None, None)] + [("New York City never sleeps", "en")] * 50
    want = plain(rows, 3, 4, 80)
    assert len(want) > 100
    assert mined(spark, rows) == want


def test_shards_and_long_texts_change_nothing(spark):
    rows = some_rows(2, 200) + [("a b the of " * 3000 + ". " + "no end " * 3000, "en")]
    want = plain(rows, 5, 4, 80)
    assert mined(spark, rows, 5, size=900, parts=4) == want
    assert mined(spark, rows, 5, size=1 << 20, parts=1) == want


def test_other_lengths_and_shares(spark):
    rows = some_rows(3, 200)
    for longest, share in ((2, 80), (3, 50), (6, 101)):
        assert mined(spark, rows, 4, longest, share) == plain(rows, 4, longest, share)


def test_empty_tables(spark):
    assert mined(spark, []) == set() and mined(spark, [(None, None), ("", "en")]) == set()


def test_ranks_with_ties(spark):
    rows = [(lang, f"{c}{i % 7} é{i}", i % 3, i % 2) for lang in ("a", "b") for c in "xyé" for i in range(90)]
    df = spark.createDataFrame(rows, "lang string, phrase string, score long, a long").repartition(4)
    got = [(r.lang, r["rank"], r.phrase) for r in phrases.ranked(df, 100).orderBy("lang", "rank").collect()]
    want = []
    for lang in ("a", "b"):
        own = sorted((x for x in rows if x[0] == lang), key=lambda x: (-x[2], -x[3], x[1].encode()))[:100]
        want += [(lang, i + 1, x[1]) for i, x in enumerate(own)]
    assert got == want


def test_intervals_count_and_extend():
    rnd = np.random.default_rng(4)
    text = np.append(rnd.integers(0, 6, 2000), 0).astype(np.int32)
    fwd, rev = phrases.transform(text, 4), phrases.transform(text[::-1], 4)
    fwd_rows, rev_rows = phrases._rows_of(fwd), phrases._rows_of(rev)
    grow = lambda low, k: phrases.extended(rev, fwd_rows, rev_rows, low, *phrases.located(fwd_rows, rev_rows, low, k))
    counts = np.bincount(text)
    low, grams = (np.cumsum(counts) - counts)[1:], [(w,) for w in range(1, 6)]
    assert phrases.located(fwd_rows, rev_rows, low, 1)[0].tolist() == counts[1:].tolist()
    for k in range(2, 5):
        new_low, count, head, tail = grow(low, k - 1)
        made = [grams[h] + (grams[t][-1],) for h, t in zip(head, tail, strict=True)]
        assert all(grams[h][1:] == grams[t][:-1] for h, t in zip(head, tail, strict=True))
        want = Counter(tuple(text[i : i + k].tolist()) for i in range(len(text) - k + 1) if (text[i : i + k] > 0).all())
        assert dict(zip(made, count.tolist(), strict=True)) == want
        assert phrases.located(fwd_rows, rev_rows, new_low, k)[0].tolist() == count.tolist()
        if k == 2:  # without some of them, the longer ones that hold them go
            held = np.sort(rnd.permutation(len(made))[: len(made) * 3 // 4])
            full, part = grow(new_low, 2), grow(new_low[held], 2)
            some = set(held.tolist())
            assert len(part[0]) == sum(h in some and t in some for h, t in zip(full[2].tolist(), full[3].tolist(), strict=True))
        low, grams = new_low, made


def test_parts_and_heads_of_several_parts_change_nothing(spark, monkeypatch):
    rows = some_rows(5, 400) + [("a b the of " * 300, "en")] * 3
    want = plain(rows, 3, 4, 80)
    for part, head in ((40, 1 << 18), (40, 5), (1 << 21, 5)):
        monkeypatch.setattr(phrases, "PART", part)
        monkeypatch.setattr(phrases, "HEAD", head)
        assert mined(spark, rows, size=4000) == want


def test_a_shard_sends_a_part_one_row_of_few_bytes(spark):
    rnd = random.Random(6)
    words = [f"w{int(1.003 ** rnd.randrange(2500))}" for _ in range(200_000)]
    df = spark.createDataFrame([(" ".join(words[i : i + 400]), "en") for i in range(0, len(words), 400)], "text string, lang string").repartition(3)
    shards, table = phrases.index(df, F.col("text"), F.col("lang"), 4, 200_000)
    places = shards.filter("word is not null").select((F.col("shard") * phrases._ROWS_A_SHARD + F.col("at")).alias("place"), "n", "lang", "word")
    sent = phrases._summed_words(places, 3, 4).filter("grams is not null").select("shard", "m", "grams")
    got = phrases._level(shards, sent, 1, 4).select("shard", "part", "m", F.length("grams").alias("size")).collect()
    spark.sql(f"DROP TABLE {table}")
    assert len({r.shard for r in got}) > 2 and {r.part for r in got} == set(range(4))
    assert len(got) == len({(r.shard, r.part) for r in got})
    assert sum(r.m for r in got) > 50_000 and sum(r.size for r in got) < 6 * sum(r.m for r in got)


def test_differences_are_added_again():
    x = np.array([5, 9, 3, 1 << 60, -7, -7, 0, 2])
    new = np.array([True, False, False, True, False, False, True, False])
    assert phrases._added(phrases._differences(x, new), new).tolist() == x.tolist()
    packed = phrases._packed([x, -x])
    assert [c.tolist() for c in phrases._unpacked(pa.scalar(packed), len(x), 2)] == [x.tolist(), (-x).tolist()]


def test_query_equals_its_sql(spark, sf):
    import duckdb

    from folioflow.llm.queries import QUERIES
    from folioflow.llm.sql import ORACLES

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    con.execute(ORACLES["op13_phrases"])
    names = [d[0] for d in con.description]
    want = {tuple(r) for r in con.fetchall()}
    assert {tuple(r) for r in QUERIES["op13_phrases"](spark, sf).select(*names).collect()} == want


def test_a_shard_is_sorted_in_bounded_memory():
    import tracemalloc

    text = np.random.default_rng(5).integers(0, 30_000, 1 << 19).astype(np.int32)
    tracemalloc.start()
    phrases.transform(text, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 33 * len(text)


def test_places_in_the_order_of_keys():
    rnd = np.random.default_rng(6)
    for most in (0, 5, 1 << 40, (1 << 62) - 1):
        key = rnd.integers(0, most + 1, 1000)
        order, new = phrases._sorted_places(key.copy(), most)
        got = key[order]
        assert (got == np.sort(key)).all() and sorted(order.tolist()) == list(range(1000))
        assert (new[1:] == (got[1:] != got[:-1])).all() and not new[0]


def test_words_of_many_texts_are_those_of_one(monkeypatch):
    texts = [(t or "").encode() for t, _ in some_rows(7, 200)]
    ids, words = phrases._words(b"\n".join(texts))
    monkeypatch.setattr(phrases.in_runs, "__defaults__", (500,))
    got, found = phrases._all_words(texts)
    pieces = lambda ids, words: [[words[i - 1] for i in run if i] for run in np.split(ids, np.flatnonzero(ids == 0)) if (run > 0).any()]
    assert found.to_pylist() == words.to_pylist()
    assert pieces(got, words.to_pylist()) == pieces(ids, words.to_pylist())
