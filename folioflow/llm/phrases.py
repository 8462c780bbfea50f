"""Collocations by FM-indexes over word ids.

Each task parts the texts that it reads into words and builds, a shard of some megabytes at a time, two Burrows-Wheeler
transforms: of the shard's words and of the same words backwards, each ordered by as many words as the longest phrase
has. An n-gram is an interval in either. The symbols of the backward transform within its interval are the words that
follow it, so their counts are those of the n-grams one word longer; with the numbers of smaller symbols they give the
new interval in the forward transform, and ranks in the backward transform give that one's. The step that the forward
transform makes from a row to the next word's tells the interval of an n-gram without its first word. So a shard
extends all of its intervals at once, and keeps those whose two parts, without the last and without the first word,
are frequent in the whole corpus.

The shards' counts are summed between the levels: an n-gram is told by the ids of its two parts. Words have symbols in
the order of a checksum, and ids rise with symbols, so that what follows a head comes in the order of its ids. A sum below the least frequency ends an n-gram, and no longer one can have it inside; what is
left goes back to the shards. Nothing is cut off: the counts are exact. A shard sends an n-gram once at most, however
often it occurs. N-grams are dealt by their head into parts whose number grows with the corpus, heads of very many over
several; what a shard and a part send each other is one row, whose n-grams are packed in the order of their places, as
differences. The index is written once, in buckets by shard, and is not shuffled for the levels.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.arrow import RUN_BYTES, WORD_BASE, in_runs, mix, scratch, written
from folioflow.sources.shared import discard

#: Bytes of text in a shard, and symbols of an index in a row.
SHARD, ROW = 12 << 20, 1 << 20
#: A shard's number is the task's and one of so many for each task; a place is a shard's number and a row in its index.
_SHARDS_A_TASK = 1 << 11
_ROWS_A_SHARD = 1 << 32
#: An id is the part's number and one of so many within it.
_IDS_A_PART = 1 << 32
#: Words of the corpus for each part of the n-grams; occurrences of a head for each part that it is dealt over.
PART, HEAD = 1 << 21, 1 << 18
#: Parts into which a language's phrases are dealt to rank them.
SALTS = 64

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
# fixed values: characters that end a piece, and that part words
_PIECE_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_WORD, _PIECE_END = np.ones(256, bool), np.zeros(256, bool)
_WORD[list(_PIECE_ENDS + _BLANKS)] = False
_PIECE_END[list(_PIECE_ENDS)] = True
_FIELDS = pa.schema([("shard", pa.int64()), ("at", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("fwd", pa.binary()), ("rev", pa.binary())])


def _words(raw: bytes) -> tuple[np.ndarray, pa.Array]:
    """The words of a text as ids from 1 in the order of their first occurrence, with one 0 between pieces; and the words."""
    raw = raw.translate(_LOWER)
    buf = np.frombuffer(b"\n" + raw + b"\n", np.uint8)
    word = _WORD[buf]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    if not len(edges):
        return np.zeros(0, np.int32), pa.array([], pa.string())
    # words and what is between them, by turns
    offsets = pa.py_buffer(edges.astype(np.int32))
    both = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, offsets, pa.py_buffer(buf)])
    own = both.take(pa.array(np.arange(0, len(edges), 2))).dictionary_encode()
    ended = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(_PIECE_END[buf], out=ended[1:])
    new_piece = np.append(True, ended[edges[2::2]] > ended[edges[1:-1:2]])
    del ended, edges, word
    at = np.arange(len(own)) + np.cumsum(new_piece)
    out = np.zeros(at[-1] + 1, np.int32)
    out[at] = own.indices.to_numpy() + 1
    return out, own.dictionary.cast(pa.string())


def _all_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The _words of all texts one behind another; about RUN_BYTES of text are parted at once."""
    parted = [_words(b"\n".join(texts[i:j])) for i, j in in_runs(texts)]
    words = pa.concat_arrays([x for _, x in parted]).dictionary_encode()
    own, begin = words.indices.to_numpy() + 1, 0
    for k, (ids, found) in enumerate(parted):
        parted[k] = np.append(np.int32(0), own[begin : begin + len(found)])[ids]
        begin += len(found)
    return np.concatenate(parted), words.dictionary


def _checksums(words: pa.Array) -> np.ndarray:
    out = np.empty(len(words), np.int64)
    for k in range(0, len(words), 1 << 14):
        some = words.slice(k, 1 << 14).cast(pa.binary()).to_pylist()
        out[k : k + len(some)] = [zlib.crc32(x) for x in some]
    return out


def _sorted_places(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the keys, which are at most most and may be overwritten, in the order of these; and for each place in that order, whether its key is another than the one before."""
    bits = max(1, (len(key) - 1).bit_length())
    if most >> (64 - bits):
        order = np.argsort(key)
        key = key[order]
    else:  # a key and its place are one number, so that numbers are sorted where they are
        key = key.view(np.uint64)
        key <<= np.uint64(bits)
        key |= np.arange(len(key), dtype=np.uint32)
        key.sort()
        order = (key & np.uint64((1 << bits) - 1)).astype(np.int32)
        key >>= np.uint64(bits)
    return order, np.append(False, key[1:] != key[:-1])


def transform(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each place of a circular text, the places ordered by the depth symbols (a power of two) from there on."""
    rank, step, order = symbols.astype(np.int32), 1, None
    while step < depth:
        most = int(rank.max())
        key = rank.astype(np.int64)
        key *= most + 1
        key += np.roll(rank, -step)
        order, new = _sorted_places(key, most * (most + 2))
        del key
        rank[order] = np.cumsum(new, dtype=np.int32)
        step *= 2
    return symbols[order - 1]


def _rows_of(symbols: np.ndarray) -> np.ndarray:
    """symbol * n + row, ascending: the rows of each symbol in order, behind those of smaller ones."""
    rows = symbols.astype(np.int64)
    rows *= len(rows)
    rows += np.arange(len(rows))
    rows.sort()
    return rows


def located(fwd_rows: np.ndarray, rev_rows: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and rev_low of n-grams of k words from their low: the words are read off the forward transform, then looked up in the other."""
    n = len(fwd_rows)
    row, words = low, []
    for _ in range(k):
        words.append(fwd_rows[row] // n)  # the sorted rows begin with the symbols' first column
        row = fwd_rows[row] % n
    begin = np.searchsorted(rev_rows, words[0] * n)
    end = np.searchsorted(rev_rows, (words[0] + 1) * n)
    for w in words[1:]:
        begin, end = np.searchsorted(rev_rows, w * n + begin), np.searchsorted(rev_rows, w * n + end)
    return end - begin, begin


def extended(rev: np.ndarray, fwd_rows: np.ndarray, rev_rows: np.ndarray, low: np.ndarray, size: np.ndarray, rev_low: np.ndarray) -> tuple[np.ndarray, ...]:
    """All n-grams one word longer than the given ones that have a given one at either end: low, size, and the indexes of the ones without the last and without the first word.

    The given n-grams are of one length and in the order of low; *_rows are the transforms' rows (see _rows_of).
    """
    n = len(rev)
    base = int(fwd_rows[-1]) // n + 1
    begin = np.cumsum(size) - size
    at = np.repeat(rev_low - begin, size)
    at += np.arange(len(at))
    follow = rev[at]
    del at
    key = np.repeat(np.arange(len(low)) * base, size)
    key += follow
    del follow
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    head, symbol = key[first] // base, key[first] % base
    new_low = low[head] + first - begin[head]
    real = symbol > 0
    count, head, new_low = (x[real] for x in (count, head, new_low))
    after = fwd_rows[new_low] % n  # the row of the place one word on
    tail = np.searchsorted(low, after, "right") - 1
    held = (tail >= 0) & (after < (low + size)[tail])
    return tuple(x[held] for x in (new_low, count, head, tail))


def _pieces_of(text: bytes, limit: int) -> Iterator[bytes]:
    """A text in runs of pieces of about so many bytes."""
    at = 0
    while len(text) - at > limit:
        m = re.compile(b"[" + re.escape(_PIECE_ENDS) + b"]").search(text, at + limit)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def _indexed(texts: dict[str, list[bytes]], shard: int, depth: int) -> Iterator[pa.RecordBatch]:
    """A shard's rows: a row for each word with its interval and count, then both transforms in rows of so many symbols. The texts are taken out."""
    symbols, words, langs, base = [], [], [], 0
    for lang in list(texts):
        ids, found = _all_words(texts.pop(lang))
        ids[ids > 0] += base
        base += len(found)
        symbols.append(ids)
        words.append(found)
        langs += [lang] * len(found)
    if not base:
        return
    words = pa.concat_arrays(words)
    order = np.argsort(_checksums(words))
    symbol = np.zeros(base + 1, np.int32)
    symbol[order + 1] = np.arange(1, base + 1)
    whole = symbol[np.append(np.concatenate(symbols), np.int32(0))]
    del symbols, ids, found
    words, langs = words.take(pa.array(order)), pa.array(langs).take(pa.array(order))
    counts = np.bincount(whole, minlength=base + 1)
    lows = np.cumsum(counts) - counts

    def batch(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard] * rows, pa.int64()), *[columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in list(_FIELDS)[1:]]], schema=_FIELDS)

    for k in range(0, base, 1 << 16):
        m = min(1 << 16, base - k)
        yield batch(m, at=pa.array(lows[k + 1 : k + 1 + m]), lang=langs.slice(k, m), word=words.slice(k, m), n=pa.array(counts[k + 1 : k + 1 + m]))
    fwd, rev = transform(whole, depth), transform(whole[::-1], depth)
    codec = pa.Codec("zstd", compression_level=1)
    for k in range(0, len(whole), ROW):
        packed = [pa.array([codec.compress(x[k : k + ROW].tobytes(), asbytes=True)], pa.binary()) for x in (fwd, rev)]
        yield batch(1, at=pa.array([k]), n=pa.array([len(fwd[k : k + ROW])]), fwd=packed[0], rev=packed[1])


def index(df: DataFrame, text: Column, lang: Column, depth: int, size: int = SHARD) -> tuple[DataFrame, str]:
    """The shards' words and transforms, as a table in buckets by shard (shard, at, lang, word, n, fwd, rev), and its name.

    A narrow pass; a shard is a run of a task's rows, or of a text's pieces if that is longer. Null texts have no words,
    a null language is `und`.
    """
    spark = df.sparkSession
    rows = df.select(text.alias("text"), F.coalesce(lang, F.lit("und")).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() * _SHARDS_A_TASK
        end = shard + _SHARDS_A_TASK
        held: dict[str, list[bytes]] = {}
        n = 0
        for b in batches:
            for lang, x in zip(b.column(1).to_pylist(), b.column(0), strict=True):
                for some in _pieces_of((x.as_py() or "").encode(), min(size, RUN_BYTES)):
                    held.setdefault(lang, []).append(some)
                    n += len(some) + 1
                    if n >= size:
                        if shard == end:
                            raise ValueError(f"over {_SHARDS_A_TASK} shards in a task: read the table in more partitions")
                        yield from _indexed(held, shard, depth)
                        n, shard = 0, shard + 1
        if held:
            yield from _indexed(held, shard, depth)

    made = rows.mapInArrow(run, "shard long, at long, lang string, word string, n long, fwd binary, rev binary")
    name = f"phrases_{uuid.uuid4().hex}"
    buckets = max(1, min(10_000, rows.rdd.getNumPartitions()))
    made.write.format("parquet").bucketBy(buckets, "shard").option("path", scratch(spark, "phrases")).saveAsTable(name)
    return spark.table(name), name


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers, each by its numbers' first bytes, then their second ones and so on, compressed."""
    planes = np.stack(columns).astype("<i8").view(np.uint8).reshape(len(columns), -1, 8)
    return pa.Codec("zstd", compression_level=1).compress(planes.transpose(0, 2, 1).tobytes(), asbytes=True)


def _unpacked(packed: pa.BinaryScalar, n: int, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(packed.as_buffer(), 8 * n * columns, "zstd"), np.uint8).reshape(columns, 8, n)
    return list(np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8")[:, :, 0])


def _runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin of each run of equal values, and whether a value begins one."""
    new = np.append(True, of[1:] != of[:-1])[: len(of)]
    return np.flatnonzero(new), new


def _before(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The value before each, 0 where a run begins."""
    return np.where(new, 0, np.append(0, x[:-1])[: len(x)])


def _differences(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The difference to the value before, or the value itself where a run begins; less than 0 as odd numbers."""
    d = x - _before(x, new)
    return (d << 1) ^ (d >> 63)


def _added(d: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What _differences were taken of."""
    d = (d >> 1) ^ -(d & 1)
    total, first = np.cumsum(d), np.flatnonzero(new)
    return total - np.repeat(total[first] - d[first], np.diff(np.append(first, len(d))))


def _begin(n: int) -> np.ndarray:
    return np.arange(n) == 0


def _sent(place: np.ndarray, ids: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each shard its n-grams' number and, packed, their places, ids, and the numbers of parts that they are dealt over as heads."""
    order = np.argsort(place)
    shard, low = np.divmod(place[order], _ROWS_A_SHARD)
    first, new = _runs(shard)
    columns = low - _before(low, new), _differences(ids[order], new), shares[order]
    cuts = np.append(first, len(shard))
    return shard[first], np.diff(cuts), pa.array([_packed([c[i:j] for c in columns]) for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())


def _both(rows: dict[str, pa.Array | np.ndarray], sent: tuple, schema: pa.Schema) -> pa.Table:
    """Rows of n-grams, and behind them those for the shards."""
    own, far = pa.table(rows), pa.table(dict(zip(("shard", "m", "grams"), sent, strict=True)))
    full = [pa.table([t[x.name].cast(x.type) if x.name in t.column_names else pa.nulls(len(t), x.type) for x in schema], schema=schema) for t in (own, far)]
    return pa.concat_tables(full).combine_chunks()


def _summed_words(rows: DataFrame, least: int, parts: int) -> DataFrame:
    """Of the shards' words that are frequent in all shards together a row each: id, lang, word and f; and rows for the shards as _summed_grams has them."""
    fields = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()), ("shard", pa.int64()), ("m", pa.int64()), ("grams", pa.binary())])

    def add(own: pa.Table) -> pa.Table:
        lang, word = (own[c].combine_chunks().dictionary_encode() for c in ("lang", "word"))
        kinds, where = np.unique(lang.indices.to_numpy() * np.int64(len(word.dictionary)) + word.indices.to_numpy(), return_inverse=True)
        f = np.zeros(len(kinds), np.int64)
        np.add.at(f, where, own["n"].to_numpy())
        kept = np.flatnonzero(f >= least)
        of_lang, of_word = np.divmod(kinds[kept], len(word.dictionary))
        order = np.argsort(_checksums(word.dictionary.take(pa.array(of_word))))
        kept, of_lang, of_word = kept[order], of_lang[order], of_word[order]
        ids = np.full(len(kinds), -1)
        ids[kept] = own["part"][0].as_py() * _IDS_A_PART + np.arange(len(kept))
        some = ids[where] >= 0
        rows = {"id": ids[kept], "lang": lang.dictionary.take(pa.array(of_lang)), "word": word.dictionary.take(pa.array(of_word)), "f": f[kept]}
        return _both(rows, _sent(own["place"].to_numpy()[some], ids[where[some]], f[where[some]] // HEAD + 1), fields)

    dealt = rows.withColumn("part", F.expr(f"crc32(cast(word as binary)) * {parts} div {1 << 32}"))
    return written(dealt.groupBy("part").applyInArrow(add, "id long, lang string, word string, f long, shard long, m long, grams binary"), "words")


def _level(shards: DataFrame, known: DataFrame, k: int, parts: int) -> DataFrame:
    """The n-grams of each shard one word longer than the frequent ones of k words, a row for each part: part, shard, m (their number) and grams.

    grams packs place, number, and the ids of both parts; known is what _summed_grams
    has for the shards. Only places and ids go to the shards; the intervals are found again in their indexes.
    """
    fields = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("m", pa.int64()), ("grams", pa.binary())])

    def grow(own: pa.Table, known: pa.Table) -> pa.Table:
        if not len(known) or not len(own):
            return fields.empty_table()
        own = own.sort_by("at")
        sizes = own["n"].to_pylist()
        fwd, rev = (np.concatenate([np.frombuffer(pa.decompress(x.as_buffer(), 4 * m, "zstd"), np.int32) for x, m in zip(own[c], sizes, strict=True)]) for c in ("fwd", "rev"))
        fwd_rows = _rows_of(fwd)
        del fwd
        rev_rows = _rows_of(rev)
        shard = known["shard"][0].as_py()
        packed = [_unpacked(x, m, 3) for x, m in zip(known["grams"], known["m"].to_pylist(), strict=True)]
        low, ids, shares = (np.concatenate(x) for x in zip(*[(np.cumsum(gap), _added(i, _begin(len(i))), n) for gap, i, n in packed], strict=True))
        del packed
        order = np.argsort(low)
        low, ids, shares = low[order], ids[order].view(np.uint64), shares[order].astype(np.uint64)
        low, n, head, tail = extended(rev, fwd_rows, rev_rows, low, *located(fwd_rows, rev_rows, low, k))
        del own, known, fwd_rows, rev_rows, rev
        part = (mix(ids[head] + mix(ids[tail]) % shares[head] * np.uint64(WORD_BASE)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        part, low, n = part[order], low[order], n[order]
        head, tail = (ids[x[order]].view(np.int64) for x in (head, tail))
        del order, ids, shares
        first, new = _runs(part)
        other = new | (head != _before(head, new))
        columns = low - _before(low + n, new), n, _differences(head, new), _differences(tail, other)
        cuts = np.append(first, len(part))
        grams = [_packed([c[i:j] for c in columns]) for i, j in zip(cuts, cuts[1:], strict=False)]
        return pa.table([pa.array(part[first].astype(np.int64)), pa.array(np.full(len(first), shard)), pa.array(np.diff(cuts)), pa.array(grams, pa.binary())], schema=fields)

    index_rows = shards.filter("fwd is not null").select("shard", "at", "n", "fwd", "rev")
    return index_rows.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(grow, "part long, shard long, m long, grams binary")


def _summed_grams(rows: DataFrame, least: int, name: str, back: bool) -> DataFrame:
    """Of n-grams that are frequent in all shards together a row each: id, head, tail and f; with back also rows for the shards: shard, m and grams, which packs place, id and the number of parts of a head."""
    fields = pa.schema([*[(c, pa.int64()) for c in ("id", "head", "tail", "f", "shard", "m")], ("grams", pa.binary())])

    def add(own: pa.Table) -> pa.Table:
        columns = []
        for shard, m, x in zip(own["shard"].to_pylist(), own["m"].to_pylist(), own["grams"], strict=True):
            gap, n, head, tail = _unpacked(x, m, 4)
            columns.append((shard * _ROWS_A_SHARD + np.cumsum(gap) + np.cumsum(n) - n, n, _added(head, _begin(m)), _added(tail, _begin(m) | (head != 0))))
        place, n, head, tail = (np.concatenate(x) for x in zip(*columns, strict=True))
        del columns
        order = np.lexsort((tail, head))
        place, n, head, tail = place[order], n[order], head[order], tail[order]
        first = np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])))
        f, many = np.add.reduceat(n, first), np.diff(np.append(first, len(n)))
        kept = f >= least
        first, f, some = first[kept], f[kept], np.repeat(kept, many)
        ids = own["part"][0].as_py() * _IDS_A_PART + np.arange(len(f))
        rows = {"id": ids, "head": head[first], "tail": tail[first], "f": f}
        many, place = many[kept], place[some] if back else place[:0]
        del n, head, tail, order
        return _both(rows, _sent(place, *(np.repeat(x, many) if back else x[:0] for x in (ids, f // HEAD + 1))), fields)

    return written(rows.groupBy("part").applyInArrow(add, "id long, head long, tail long, f long, shard long, m long, grams binary"), name)


def mine(df: DataFrame, text: Column, lang: Column, least: int = 30, longest: int = 4, share: int = 80, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): the frequent phrases of 2 to longest words of each language, and each language's number of words.

    phrases: lang, phrase, words, a (its occurrences), l and r (those of its two parts at the cut that scores least),
    score (floor of 2,000,000 a / (l + r) there, equal scores going to the first cut). Phrases of under least
    occurrences have no row, nor those inside of a longer one that has share hundredths of their occurrences. Case of
    A-Z and white space don't matter, and no phrase crosses the end of a piece. Null and empty texts have no words, a
    null language is `und`; texts may repeat and be of any length.
    """
    if not 2 <= longest <= 16:
        raise ValueError("phrases of 2 to 16 words")
    shards, table = index(df, text, lang, 1 << (longest - 1).bit_length(), size)
    words = shards.filter("word is not null")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    places = words.select((F.col("shard") * _ROWS_A_SHARD + F.col("at")).alias("place"), "n", "lang", "word")
    parts = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // PART))
    frequent = _summed_words(places, least, parts)
    known = frequent.filter("grams is null").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    sent = frequent.filter("grams is not null").select("shard", "m", "grams")
    levels, spent = [], [shards]
    for k in range(2, longest + 1):
        spent.append(frequent)
        frequent = _summed_grams(_level(shards, sent, k - 1, parts), least, f"phrases-{k}", k < longest)
        sent = frequent.filter("grams is not null").select("shard", "m", "grams")
        head, tail = known.select(F.col("id").alias("head"), "lang", "phrase", "heads"), known.select(F.col("id").alias("tail"), "last", "tails")
        known = frequent.filter("grams is null").select("id", "head", "tail", "f").join(head, "head").join(tail, "tail")
        known = known.select("id", "head", "tail", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", F.array_append("heads", F.col("f")).alias("heads"), F.array_append("tails", F.col("f")).alias("tails"))
        known = written(known, f"known-{k}")
        levels.append(known.withColumn("words", F.lit(k)))
    discard(*spent, frequent)
    df.sparkSession.sql(f"DROP TABLE {table}")
    wide = F.col("f").cast("decimal(20,0)")
    # an n-gram inside of a longer one is inside of one a single word longer that is as frequent at least
    inside = [
        x.select(F.col("head").alias("id"), "f").union(x.select(F.col("tail").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("longer")) for x in levels[1:]
    ]
    kept = [x.join(y, "id", "left").filter(F.coalesce(wide * share > F.col("longer").cast("decimal(20,0)") * 100, F.lit(True))).drop("longer") for x, y in zip(levels, inside, strict=False)]
    rows = reduce(DataFrame.unionByName, [*kept, levels[-1]])
    cut = F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.struct(F.get("heads", k - 1).alias("l"), F.get("tails", F.col("words") - k - 1).alias("r"), k.alias("k")),
    )
    scored = F.transform(cut, lambda c: F.struct(F.call_function("div", F.lit(2_000_000).cast("decimal(8,0)") * wide, c["l"].cast("decimal(20,0)") + c["r"]).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    best = rows.withColumn("best", F.array_min(scored))
    return best.select("lang", "phrase", "words", F.col("f").alias("a"), "best.l", "best.r", "best.score"), totals


def ranked(phrases: DataFrame, most: int) -> DataFrame:
    """Each language's first phrases by score, occurrences (both descending) and phrase (by its UTF-8 bytes), with rank from 1.

    Phrases are dealt by hash first and only the first of each part meet in one task.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = phrases.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most).drop("part")
