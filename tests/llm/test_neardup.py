"""Near-duplicates against brute force over all pairs, and on rows that are odd."""

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import neardup, queries
from folioflow.llm.components import components


def classes(pairs, nodes) -> dict:
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def brute(rows: list[tuple[int, str]]) -> tuple[dict, dict]:
    """Least id of each class, and the similarities of all pairs that share a shingle."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = {k: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for k, t in rows}
    df = defaultdict(int)
    for w in words.values():
        for x in set(w):
            df[x] += 1
    n = len(rows)
    scaled = {x: np.log(n / d) / np.log(1 / neardup.RARE) if d >= neardup.RARE * n else 1.0 for x, d in df.items()}
    sets = {}
    for k, w in words.items():
        own = defaultdict(float)
        for i in range(max(1, len(w) - 4) if w else 0):
            s = tuple(w[i : i + 5])
            own[s] += 1 + sum(scaled[x] for x in s) / len(s)
        sets[k] = own
    where = defaultdict(list)
    for k, own in sets.items():
        for s in own:
            where[s].append(k)
    least = defaultdict(float)
    for s, ks in where.items():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                least[min(a, b), max(a, b)] += min(sets[a][s], sets[b][s])
    total = {k: sum(own.values()) for k, own in sets.items()}
    sim = {(a, b): m / (total[a] + total[b] - m) for (a, b), m in least.items()}
    texts = defaultdict(list)
    for k, t in rows:
        texts[t or ""].append(k)
    links = [p for p, j in sim.items() if j >= 0.8] + [(min(v), k) for v in texts.values() for k in v]
    return classes(links, [k for k, _ in rows]), sim


def test_classes_equal_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, sim = brute(rows)
    got = {r["doc_id"]: r["class_id"] for r in queries.op4_neardup(spark, sf).collect()}
    assert got == want and len(set(want.values())) < len(want)
    pairs = [p for p, j in sim.items() if j > 0.5][:200]
    text = dict(rows)
    n, *idf = neardup.document_frequencies(spark.createDataFrame(rows, "k long, t string"), F.col("t"))
    ours = neardup.similarities([text[a].encode() for a, _ in pairs], [text[b].encode() for _, b in pairs], tuple(idf))
    np.testing.assert_allclose(ours, [sim[p] for p in pairs], atol=1e-5)


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    agree, true = [], []
    for k in range(60):
        part = rng.choice(h, 120, replace=False)
        a, b = np.sort(part[:90]), np.sort(part[20:])
        wa, wb = (rng.uniform(1, 4, len(x)).astype(np.float32) for x in (a, b))
        ia, ib = dict(zip(a, wa)), dict(zip(b, wb))
        low = sum(min(ia[x], ib[x]) for x in ia.keys() & ib.keys())
        true.append(low / (wa.sum() + wb.sum() - low))
        _, s = neardup.samples(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.concatenate([wa, wb]))
        agree.append(np.mean(s[0] == s[1]))
    assert abs(np.mean(agree) - np.mean(true)) < 0.02


def test_a_chain_of_copies_is_one_class(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    rows = []
    for i in range(12):  # each differs from the next in six words, the ends in many
        base = list(base)
        base[10 * i : 10 * i + 3] = [f"x{i}{j}" for j in range(3)]
        rows.append((i, " ".join(base)))
    want, sim = brute(rows)
    assert set(want.values()) == {0} and min(sim.values()) < 0.8
    df = spark.createDataFrame(rows, "k long, t string")
    assert {r["class_id"] for r in neardup.groups(df, F.col("t"), F.col("k")).collect()} == {0}


def test_a_hot_bucket_loses_no_link(spark, monkeypatch):
    """All texts share a bucket; around one leader lie copies, and further out classes of their own that link among each other."""
    rng = np.random.default_rng(7)
    word = lambda: f"w{rng.integers(0, 10**7)}"
    base = [word() for _ in range(200)]
    rows = []
    for change in (0, 0, 0, 60, 60, 90, 90, 140, 140, 190, 190):  # pairs that are alike, at growing distance from the base
        own = rows[-1][1].split() if rows and rows[-1][2] == change and change else base[: 200 - change] + [word() for _ in range(change)]
        own = list(own)
        own[rng.integers(200)] = word()
        rows.append((len(rows), " ".join(own), change))
    rows += [(100 + i, " ".join(base[:i] + [word()] + base[i + 1 :]), 0) for i in range(40)]
    want, sim = brute([r[:2] for r in rows])
    monkeypatch.setattr(neardup, "bands", lambda taken: np.tile(np.arange(1, neardup.BANDS + 1, dtype=np.uint64), (len(taken), 1)))
    df = spark.createDataFrame(rows, "k long, t string, d int")
    for block, size in ((500, 8 << 20), (3, 8 << 20), (500, 3000)):
        got = {r["key"]: r["class_id"] for r in neardup.groups(df, F.col("t"), F.col("k"), block=block, block_bytes=size).collect()}
        assert got == want
    assert len(set(want.values())) == 5


def test_odd_rows(spark):
    rows = [(3, None, "a"), (2, "", "b"), (9, "...", "c"), (4, "The and of", "d"), (5, "the AND, of", "e"), (None, "x y z w v u", "f"), (6, "x y z w v u", "g"), (6, "x y z w v u", "h"), (None, "alone it is here now", "i"), (8, "q " * 20000, "j")]
    df = spark.createDataFrame(rows, "key long, text string, g string")
    got = neardup.groups(df, F.col("text"), F.col("key")).collect()
    assert sorted((r["class_id"] is None, r["class_id"] or 0, r["class_size"]) for r in got) == [(False, 2, 2)] * 2 + [(False, 4, 2)] * 2 + [(False, 6, 3)] * 3 + [(False, 8, 1), (False, 9, 1), (True, 0, 1)]
    kept = neardup.keep_one(df, F.col("text"), "key").collect()
    assert sorted(r["g"] for r in kept if r["key"] != 6) == ["b", "c", "d", "i", "j"] and sum(r["key"] == 6 for r in kept) == 1
    assert neardup.groups(df.limit(0), F.col("text"), F.col("key")).count() == 0
    clash = df.select("key", "text", F.col("g").alias("__g"), F.lit(1).alias("row"), F.lit(2).alias("own_g"), F.lit(3).alias("label"))
    kept = neardup.keep_one(clash, F.col("text"), "key")
    assert kept.columns == clash.columns and kept.count() == 6 and {(r["row"], r["own_g"], r["label"]) for r in kept.collect()} == {(1, 2, 3)}
    assert neardup.keep_one(clash.limit(0), F.col("text"), "key").count() == 0


def test_components(spark):
    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 300)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes(links, {x for p in links if p[0] != p[1] for x in p} | {x for p in links for x in p})
    assert got == {k: want[k] for k in got} and got.keys() == {x for p in links if p[0] != p[1] for x in p}
