"""Byte-level BPE against the tokenizers library and against merging by its definition."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm import bpe
from folioflow.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n", "  \n x", "a\x00b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "it's 'll 'tis I'Re ''s", "日本語 ½٣ naïve​  x", "é" * 50, "x" * 300, "ab" * 5000, "😀😀 😀", "퟿\U0010ffff", "\U000323b0 Ᲊa"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return bpe.Bpe(bpe.load(PATH))


def plain(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def by_definition(model, part: bytes) -> list[int]:
    """Merges the leftmost pair of lowest rank until there is none."""
    ids = model.first[np.frombuffer(part, np.uint8)].tolist()
    while True:
        ranks = [(model.rank_of.get(a << 32 | b, 1 << 40), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
        if not ranks or min(ranks)[0] == 1 << 40:
            return ids
        rank, i = min(ranks)
        ids[i : i + 2] = [int(model.made[rank])]


def test_trees_merge_the_leftmost_pair_of_lowest_rank(model):
    rnd = random.Random(5)
    parts = [bytes(rnd.choice(b"aaabehinost  rs\xc3\xa9") for _ in range(rnd.randrange(1, 64))) for _ in range(800)]
    want = [by_definition(model, x) for x in parts]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.merged(parts)] == want
    assert [np.frombuffer(model._alone(x), "<u4").tolist() for x in parts] == want


def test_ties_of_rank_go_to_the_left(model):
    for n in range(1, 66):
        for x in (b"a" * n, b"ab" * n, b" " * n):
            assert np.frombuffer(model.merged([x])[0], "<u4").tolist() == by_definition(model, x)


def test_random_texts_equal_the_library(model, library):
    rnd = random.Random(7)
    some = ["<|endoftext|>", "'ll", "'s", " ", "  ", "\n", "\t", "the", "日本", "é", "\x00", "12", "½", "x", "'", "!?", " ", "\x85", "\x1c", "a" * 70]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    ids, ends = model.encode([x.encode() for x in texts])
    got = [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]
    assert got == [plain(library, x)[0] for x in texts]
    assert [x.decode(errors="replace") for x in model.decode(ids, ends)] == [plain(library, x)[1] for x in texts]


def test_every_code_point_is_of_the_librarys_class(model):
    from tokenizers import pre_tokenizers

    parted = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    like = {bpe._LETTER: "a", bpe._DIGIT: "1", bpe._OTHER: "!", bpe._BLANK: "\n"}
    kinds = bpe._classes()
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    assert [c for c in points if len(parted(like[kinds[c]] + chr(c))) != 1] == []


def test_columns(spark, library):
    rows = [(i, x, f"c{i}") for i, x in enumerate(ODD)] * 2
    df = spark.createDataFrame(rows, "n_tokens int, text string, extra string").repartition(3)
    out = bpe.round_trip(df.withColumn("key", F.col("n_tokens")), F.col("text"), bpe.load(PATH))
    assert out.columns == ["text", "extra", "key", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {(r.key, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()}
    want = set()
    for i, x in enumerate(ODD):
        ids, text = plain(library, x)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want
    assert out.count() == 2 * len(ODD)
    coded = bpe.encode(df, F.col("text"), bpe.load(PATH), "text_ids")
    back = bpe.decode(coded, F.col("text_ids"), bpe.load(PATH), "back").collect()
    assert all(r.text_ids == plain(library, r.text)[0] and r.back == (r.text or "") for r in back)
    assert bpe.round_trip(df.limit(0), F.col("text"), bpe.load(PATH)).count() == 0


def test_decode_of_any_ids(spark, library):
    lists = [None, [], [50256, 0], [220, 10**6, -1, 220], [98, 99], [None, 64]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(df, F.col("ids"), bpe.load(PATH)).collect()}
    assert got == {i: library.decode([x for x in ids or [] if x is not None and 0 <= x < 50257], skip_special_tokens=False) for i, ids in enumerate(lists)}


def test_other_tokenizers_are_an_error():
    made = json.loads(bpe.load(PATH))
    made["normalizer"] = {"type": "NFC"}
    with pytest.raises(ValueError):
        bpe.Bpe(json.dumps(made))
    with pytest.raises(ValueError):
        bpe.Bpe(bpe.load(public_tokenizers.path("word_bpe_49k.json")))


def test_query_equals_the_library(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op12_bpe"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    for k, x in docs.items():
        ids, text = plain(library, x)
        assert got[k] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
