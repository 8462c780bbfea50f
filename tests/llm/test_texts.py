"""Page text, pieces, chat and records against plain versions and round trips, and on rows that are odd."""

import hashlib
import html as stdlib_html
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import chat, html, pieces, queries, records
from folioflow.llm.labelled_pages import labelled_pages

ODD = [(1, None), (2, ""), (3, " "), (None, "a  b\n c\td "), (5, "▁x▁▁"), (6, "the and of " * 3000), (6, "the and of " * 3000), (7, "\U0001f600\x00é ﷺ　日本"), (8, "x" * 5000), (9, "<|endoftext|> a<|endoftext|> b don't  'll")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash") for r in ODD], "doc_id long, text string, ids string")


def test_pages_equal_their_articles(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op2_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        want = " ".join(stdlib_html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), pages[r["page_id"]]["url"])


def test_page_model_on_other_make_ups_and_odd_pages(spark, sf):
    model = html.train(spark.read.parquet(f"{sf}/pages.parquet"), F.col("html"), F.col("page_id"))
    forest = html.Forest([html.Tree(x) for x in labelled_pages(3, 11)])
    p, _ = forest.marginals(*model)
    truth, leaf = np.concatenate([t.truth() for t in forest.trees]), forest.leaf == 1
    assert np.mean((p[leaf] >= 0.5) == truth[leaf]) > 0.97
    body = "<article><h1>A title of it</h1><p>One &lt;two&gt; &eacute;&#233;&amp\n three, four.</p><script>var a = '</p>';</script><p>More <b>te</b>xt here, and more of it.<br>Yes.</article>"
    pages = [(1, None), (2, ""), (3, "   "), (4, "<nav><a href=x>Home</a></nav>" + body), (4, "<nav><a href=x>Home</a></nav>" + body), (5, "<" * 2000), (6, "<div>" * 3000 + "x"), (7, "<a title=\"never closed>" * 50), (8, "plain text only")]
    rows = html.extract(spark.createDataFrame(pages, "page_id long, html string"), F.col("html"), model).collect()
    assert [r["text"] for r in rows][:5] == ["", "", "", *["A title of it One <two> éé& three, four. More text here, and more of it. Yes."] * 2]
    assert len(rows) == len(pages)


def test_pages_go_on_behind_elements_that_are_never_closed():
    cases = {
        "<title>T<body><article><p>one.</p></article>": ["T", "one."],
        "<p>a</p><noscript><p>b</p><p>c</p>": ["a", "b", "c"],
        "<p>a</p><svg><text>no</text></svg><p>b</p>": ["a", "b"],
        "<object>x<object>y</object>no</object>k": ["k"],
        "<script src=x/>code()</script><p>t</p>": ["t"],
        "a<![CDATA[x > y]]>b</>c": ["abc"],
        "<svg/>k<p>l": ["k", "l"],
        "<p>u</p><style>x{}<p>v": ["u"],
        "<textarea>abc<p>def": ["abc", "def"],
        "<noscript>a<p>b</noscript>c <SVG foo='>'>d</svg >e": ["c e"],
        "<object>" * 3000 + "z": ["z"],
    }
    for page, want in cases.items():
        assert [x for x in html.Tree(page).text if x] == want, page


def test_tags_are_read_as_html_reads_them():
    cases = {
        "<p class=it's>A</p><p>We don't know.</p><p>Last.</p>": ["A", "We don't know.", "Last."],
        "<p>a<img alt='Bob's photo'>b</p><p>it's</p>": ["ab", "it's"],
        "a<!-->b<!--->c<!-- x --!>d<!--!>e-->f": ["abcdf"],
        "<p title='a > b' lang=en>A</p ><p a=>B": ["A", "B"],
        '<p title="x>A</p><p>B': ["A", "B"],
        "a < b <3 c</ d": ["a < b <3 c</ d"],
        "<p>cut off <a href='x": ["cut off"],
        "<P CLASS = nav>x<p/class=y>z": ["x", "z"],
        "<title>x</titles></TITLE >y": ["y"],
    }
    for page, want in cases.items():
        assert [x for x in html.Tree(page).text if x] == want, page
    assert html.Tree("<div id = nav>x").on[1] == html.Tree("<div id='nav'>x").on[1] != html.Tree("<div>x").on[1]


def test_hostile_pages_take_time_in_proportion():
    import time

    patterns = ["<a ", "<ul><li>", '<a b="', "<a b='>'", "<title>", "</title x", "<svg>", '<svg "', "<", "<div>", "<!--", "<!", "<![CDATA[", "</li>", "&", '<p class="', "<table><tr><td>x", "<noscript><p x='"]
    slow = []
    for x in patterns:
        for page in (x * ((1 << 20) // len(x)), x * ((1 << 20) // len(x)) + ">", "<div>" * 1000 + x * ((1 << 18) // len(x))):
            start = time.process_time()
            tree = html.Tree(page)
            html.Forest([tree]).marginals(np.zeros(html.N_FEATURES), np.zeros((2, 2, 2)))
            assert max(tree.depth) <= html.DEEPEST
            if time.process_time() - start > 8:  # a quadratic one takes minutes
                slow.append(x)
    assert slow == []


def test_lists_captions_code_and_authors(spark):
    p = "The first sentence of it is long enough, and goes on. A second one follows here, with more words in it than that."
    page = f"<nav><ul><li><a href=/>Home</a></li><li><a href=/b>News of it</a></li></ul></nav><article><h1>A heading of words</h1><p>{p}</p><ul><li>short</li><li>items</li><li>here</li></ul><p>{p}</p><figure><img src=x><figcaption>A caption.</figcaption></figure><p>{p}</p></article><div class='author-bio'><p>Someone writes about things and lives somewhere. They like other things.</p></div><footer><p>Imprint and more.</p></footer>"
    pages = spark.createDataFrame([], "page_id long, html string")
    model = html.train(pages, F.col("html"), F.col("page_id"))  # the package's pages alone
    got = html.extract(spark.createDataFrame([(1, page, 5)], "page_id long, html string, text int"), F.col("html"), model).first()
    assert got["text"] == f"A heading of words {p} short items here {p} A caption. {p}"
    assert html.extract(pages, F.col("html"), model).count() == 0


def test_tree_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    forest = html.Forest([html.Tree("<div><p>a</p><p>b <i>c</i></p></div><ul><li>d"), html.Tree("x")])
    w, edge = rng.normal(size=html.N_FEATURES), rng.normal(size=(2, 2, 2))
    own, n = forest.unary(w), forest.n
    total, seen, pair = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for m in range(2**n):
        y = [m >> k & 1 for k in range(n)]
        weight = np.exp(sum(own[i, y[i]] for i in range(n)) + sum(edge[forest.leaf[i], y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0))
        total += weight
        seen += weight * np.array(y)
        for i in range(n):
            if forest.parent[i] >= 0:
                pair[i, y[forest.parent[i]], y[i]] += weight
    p, q = forest.marginals(w, edge)
    np.testing.assert_allclose(p, seen / total, atol=1e-9)
    np.testing.assert_allclose(q, pair / total, atol=1e-9)


@pytest.fixture(scope="module")
def piece():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path), pieces.load(path)


def test_pieces_equal_the_library(spark, sf, piece, odd):
    library, model = piece
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_pieces(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    coded = pieces.decode(pieces.encode(odd, F.col("text"), model), F.col("ids"), model)
    for r, (_, text) in zip(pieces.round_trip(coded, F.col("text"), model).collect(), ODD, strict=True):
        ids = library.encode(text or "")
        assert r["ids"] == ids and r["decoded"] == library.decode(ids) and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_equal_the_library_on_any_text(piece):
    library, model = piece
    codec = pieces.Codec(model)
    known = pieces._parts(codec)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("aethin s▁\n\x00é<>=-日…"), st.characters(exclude_categories=["Cs"])), max_size=40))
    def same(text):
        plain = text.replace("▁", " ")
        ids = [i for p in pieces.parts_of(plain) for i in np.frombuffer(known[p], np.int32).tolist()] if plain else []
        assert ids == library.encode(text) and codec.decode(ids) == library.decode(ids)

    same()
    assert codec.decode([200, 3, 201, 5]) == library.decode([200, 3, 201, 5])


def test_pieces_of_empty_tables(spark, odd):
    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    assert pieces.round_trip(odd.limit(0), F.col("text"), model).count() == 0
    coded = pieces.encode(odd.limit(0), F.col("text"), model)
    assert coded.count() == 0 and pieces.decode(coded, F.col("ids"), model).count() == 0


def test_chat_round_trip(spark, sf):
    rows = [(-2, 0, "us\ner\\n", "a<\\|b <\\\\|c<|im_start|>"), (-2, 1, "assistant", "x<|im_end|>\n"), (-3, 0, None, None), (-3, None, "assistant", "<"), (-3, 2, "assistant", "<|x|> \n"), (-3, 2, "assistant", "<|x|> \n"), (-4, 1, "<|im_end|>\n", "\\"), (None, 1, "user", "z" * 100000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    given_df = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(df)
    made = chat.format_conversations(given_df, *(F.col(c) for c in ("conv_id", "turn", "role", "text"))).withColumn("lost", chat.loss_texts(F.col("formatted"), F.col("loss"))).collect()
    assert all(r["same"] for r in made)
    for r in made:
        assert r["lost"] == [t["text"] for t in r["turns"] if t["role"] == "assistant"]
        assert [s["size"] for s in r["loss"]] == [len(r["formatted"][s["first"] :].split("<|im_end|>\n")[0]) for s in r["loss"]]
    by = {r["conv"]: r for r in made}
    assert [(t["role"], t["text"]) for t in by[-3]["turns"]] == [("assistant", "<"), ("", ""), ("assistant", "<|x|> \n"), ("assistant", "<|x|> \n")]
    assert "\\" not in by[-3]["formatted"] and len(by[None]["formatted"]) > 100000
    assert chat.format_conversations(df.limit(0), *(F.col(c) for c in ("conv_id", "turn", "role", "text"))).count() == 0


def test_records_equal_the_library_and_round_trip(spark, sf, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = {r["doc_id"]: r for r in queries.op9_records(spark, sf).collect()}
    start = 0
    for k, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (rows[k]["start"], rows[k]["n_tokens"], rows[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    with open(path, encoding="utf-8") as f:
        tokenizer = f.read()
    manifest = records.write(odd, F.col("text"), F.col("doc_id"), tokenizer, end=2)
    got = records.read(manifest).orderBy("place").collect()
    want = sorted(((k, text or "") for k, text in ODD), key=lambda r: (r[0] is not None, r[0], r[1]))
    assert [(r["key"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got] == [(k, [*library.encode(x, add_special_tokens=False).ids, 2]) for k, x in want]
    first = manifest.orderBy("first").first()
    key, ids = records.read_at(first["file"], first["width"], [first["docs"] - 1])[0]
    assert key == got[first["docs"] - 1]["key"] and ids.tolist() == np.frombuffer(got[first["docs"] - 1]["ids"], "<u4").tolist()
    assert records.read(records.write(odd.limit(0), F.col("text"), F.col("doc_id"), tokenizer, end=2)).count() == 0


def test_encoder_equals_the_library_on_hostile_texts(monkeypatch):
    import random

    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    library, rng = Tokenizer.from_str(tokenizer), random.Random(1)
    plain = ["a", "b", "the", "'s", "'ll", "'", "'re", "'sx", "''s", " ", "  ", "\n", "\t", "\r\n", "1", "23", ".", ",", "!", "\u00e9", "\u00df", "_", "'T", "'d", "'ve", " '"]
    odd = ["\u00d7", "\u00f7", "\u03a9", "\u6f22", "\U0001f600", "\x00", "\x1c", "\x0b", "\xa0", "<|endoftext|>", "\u0233", "\u024f", "\u02bc", "\u00b2", "-"]
    texts = ["".join(rng.choice(plain + odd if rng.random() < 0.3 else plain) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    want = [np.array([*library.encode(x, add_special_tokens=False).ids, 2], "<u2").tobytes() for x in texts]
    for parts in (400_000, 50):  # with 50, parts are forgotten and learned again
        monkeypatch.setattr(records, "PARTS", parts)
        encoder = records.Encoder(tokenizer, "<u2")
        assert [y for i in range(0, len(texts), 2000) for y in encoder.encode([x.encode() for x in texts[i : i + 2000]], 2)] == want


def test_damaged_records_are_found():
    import io

    data = records.framed(b"abc") + records.framed(b"")
    assert list(records.unframed(io.BytesIO(data).read)) == [b"abc", b""]
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            list(records.unframed(io.BytesIO(bytes(bad)).read))
