"""Byte-level BPE by ranks, encoded and decoded in Spark's higher-order functions.

A task cuts its texts into words by the vocabulary's pattern and hands on each distinct word of
a stretch of texts once, followed by the stretch's documents as codes into those words. The
words are encoded by a fold in SQL functions: a word is its bytes, one symbol for each; the rank
map is a literal, from a pair of neighbouring symbols to the symbol that they merge into, as an
array of small texts dealt by the pair's crc32 (a map literal is searched from its start, or costs
many steps through memory); each turn looks all neighbours up, takes the lowest rank and merges
its pairs from left to right.
Decoding looks each id's bytes up in a literal list and joins the pieces. What comes back is
put in the places of the documents' codes. Rows stay in their partition throughout, so there is
no shuffle, and frequent words are encoded once a stretch.

A vocabulary is right for this if every token of several bytes comes from exactly one last
merge, of two tokens of lower rank, as in every trained one; ``merges`` finds them and refuses
others. All pairs of the lowest rank can then be merged in one turn: a merge never brings about
a pair of lower rank, so the library's one-by-one order ends in the same place. The turns of a
word are at most its distinct merges, and each turn is linear in its length.

Defined results: a null text is an empty one, with 0 tokens and the digests of empty bytes;
every row gets its own result, repeated rows the same one; null ids are kept; an empty table
has no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import Batcher, released

#: Buckets of the literal rank map, a power of two. Each is the marked pairs it holds, with what they make.
BUCKETS = 1 << 16
#: Marks a pair in its bucket, both ends of a word, and a pair that doesn't merge; sorts behind all symbols.
MARK = "\U0010ffff"
#: Bytes of text whose distinct words are encoded together.
STRETCH_BYTES = 24 << 20
#: From so many symbols on a turn looks up each distinct pair once.
LONG = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def symbol(i: int) -> str:
    """The character that stands for an id: upwards from 256, without the surrogates; order is kept."""
    return chr(i + 256 if i + 256 < 0xD800 else i + 256 + 0x800)


def last_merge(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What merging by ranks below the token's own leaves of it."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= limit:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The pair of ids that each token of several bytes is merged from."""
    if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks have to be 0, 1, ... and hold every byte")
    out = {}
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = last_merge(token, ranks)
            if len(parts) != 2:
                raise ValueError(f"token {rank} doesn't come from one merge of lower ranks")
            out[ranks[parts[0]], ranks[parts[1]]] = rank
    return out


@lru_cache(maxsize=2)
def tables(path: str) -> tuple[str, str, str]:
    """The rank map's buckets as lines, the symbols of the 256 bytes, and all tokens in hex."""
    ranks = read_ranks(path)
    buckets = [""] * BUCKETS
    for (a, b), c in merges(ranks).items():
        pair = symbol(a) + symbol(b)
        buckets[zlib.crc32(pair.encode()) & (BUCKETS - 1)] += MARK + pair + symbol(c)
    spelled = [t.hex() for t in sorted(ranks, key=ranks.get)]
    return "\n".join(b + MARK for b in buckets), "".join(symbol(ranks[bytes([b])]) for b in range(256)), " ".join(spelled)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def encoded(word: Column, path: str) -> Column:
    """The ids of a word (a text), as array<int>.

    A turn has the word's symbols between two marks, and for each two neighbours the symbol
    that they make. Short words merge the leftmost pair of the lowest rank and look up its two new
    neighbours; long ones merge all its pairs and look up all neighbours.
    """
    ranks, symbols, _ = tables(path)

    def made(pair: Column, rank_map: Column) -> Column:
        bucket = F.get(rank_map, F.crc32(pair.cast("binary")).bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int"))
        return F.left(F.call_function("substring_index", bucket, F.concat(F.lit(MARK), pair), F.lit(-1)), F.lit(1))

    def neighbours(s: Column, rank_map: Column) -> Column:
        return F.array_join(F.zip_with(F.split(s, ""), F.split(_from(s, 2), ""), lambda a, b: made(F.concat(a, b), rank_map)), "")

    def turn(have: Column, rank_map: Column) -> Column:
        s, r = have["s"], have["r"]

        def merged(low: Column) -> Column:
            def at(i: Column) -> Column:
                all_of_it = F.replace(s, F.substring(s, i, F.lit(2)), low)
                left, right = made(F.concat(F.substring(s, i - 1, F.lit(1)), low), rank_map), made(F.concat(low, F.substring(s, i + 2, F.lit(1))), rank_map)
                one = F.struct(F.concat(F.left(s, i - 1), low, _from(s, i + 2)).alias("s"), F.concat(F.left(r, i - 2), left, right, _from(r, i + 2)).alias("r"))
                return F.when(F.length(s) > LONG, _bound(all_of_it, lambda x: F.struct(x.alias("s"), neighbours(x, rank_map).alias("r")))).otherwise(one)

            return F.when(low == MARK, have).otherwise(_bound(F.instr(r, low), at))

        return _bound(F.array_min(F.split(r, "")), merged)

    def fold(s: Column, rank_map: Column) -> Column:
        first = F.struct(s.alias("s"), neighbours(s, rank_map).alias("r"))
        return F.aggregate(F.sequence(F.lit(4), F.greatest(F.length(s), F.lit(4))), first, lambda have, _: turn(have, rank_map), lambda have: have["s"])

    start = F.concat(F.lit(MARK), F.translate(F.decode(word.cast("binary"), "ISO-8859-1"), "".join(map(chr, range(256))), symbols), F.lit(MARK))
    merged = _bound(F.split(F.lit(ranks), "\n"), lambda rank_map: _bound(start, lambda s: fold(s, rank_map)))
    code = lambda c: F.ascii(c) - F.when(F.ascii(c) < 0xD800, F.lit(256)).otherwise(F.lit(256 + 0x800))
    return F.transform(F.split(F.replace(merged, F.lit(MARK), F.lit("")), ""), code)


def _from(text: Column, at: Column | int) -> Column:
    return F.substring(text, at, F.lit((1 << 31) - 1))


def decoded(ids: Column, path: str) -> Column:
    """The bytes of a list of ids."""
    spelled = F.split(F.lit(tables(path)[2]), " ")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(spelled, i)), ""))


@lru_cache(maxsize=1)
def unknown_characters() -> str:
    """Ranges of the letters and numbers that the regex module knows and the encoder's library doesn't.

    The two may follow different versions of Unicode; the library is asked for all characters.
    """
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    odd: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        ask = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        odd |= set(regex.findall(kind, every)) - set(bytes(ask.encode_ordinary(every)).decode())
    codes = sorted(map(ord, odd))
    starts = [c for c in codes if chr(c - 1) not in odd]
    ends = [c for c in codes if chr(c + 1) not in odd]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


def splitter(pattern: str, unknown: str) -> Callable[[str], list[str]]:
    """Cuts a text by a pattern in which ``unknown`` characters are neither letters nor numbers."""
    plain = regex.compile(pattern)
    if not unknown:
        return plain.findall
    odd, own = regex.compile(f"[{unknown}]"), pattern
    own = own.replace(r"[^\s\p{L}\p{N}]", "\0").replace(r"\p{L}", rf"[\p{{L}}--[{unknown}]]").replace(r"\p{N}", rf"[\p{{N}}--[{unknown}]]")
    known = regex.compile(own.replace("\0", rf"(?:[^\s\p{{L}}\p{{N}}]|[{unknown}])"), regex.V1)
    return lambda text: (plain if text.isascii() or not odd.search(text) else known).findall(text)


#: A stretch's rows: its distinct words, one a row, then one with its documents.
_ROWS = "word string, docs struct<keys:array<string>,lengths:binary,codes:binary>"
_DOCS = pa.struct([("keys", pa.list_(pa.string())), ("lengths", pa.binary()), ("codes", pa.binary())])
_SCHEMA = pa.schema([("word", pa.string()), ("docs", _DOCS)])
_OUT = "key string, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _stretches(pattern: str, unknown: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = splitter(pattern, unknown)
        keys, lengths, codes, vocab, held = [], [], array("i"), {}, 0

        def give() -> Iterator[pa.RecordBatch]:
            every = list(vocab)
            for i in range(0, len(every), 10_000):
                part = every[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.nulls(len(part), _DOCS)], schema=_SCHEMA)
            docs = {"keys": keys, "lengths": array("q", lengths).tobytes(), "codes": codes.tobytes()}
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([docs], _DOCS)], schema=_SCHEMA)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                own = cut(text)
                codes.extend([vocab.setdefault(w, len(vocab)) for w in own])
                keys.append(key)
                lengths.append(len(own))
                held += len(text) + 16
                if held >= most:
                    yield from give()
                    keys, lengths, codes, vocab, held = [], [], array("i"), {}, 0
        if keys:
            yield from give()

    return run


def _digests(docs: dict, ids: list[bytes], raw: list[bytes]) -> Iterator[tuple[str, int, str, str]]:
    """Key, tokens and digests of a stretch's documents."""
    codes, at = np.frombuffer(docs["codes"], np.int32), 0
    for key, n in zip(docs["keys"], np.frombuffer(docs["lengths"], "<i8").tolist(), strict=True):
        own = codes[at : at + n].tolist()
        at += n
        told = b"".join([ids[c] for c in own])
        back = b"".join([raw[c] for c in own])
        yield key, len(told) // 4, hashlib.sha256(told).hexdigest(), hashlib.sha256(back).hexdigest()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' digests from a stretch's encoded words and codes."""
    out = Batcher(pa.schema([("key", pa.string()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))
    ids: list[bytes] = []
    raw: list[bytes] = []
    for batch in batches:
        lists, pieces, docs = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        told, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes(), (lists.offsets.to_numpy() * 4).tolist()
        at = 0
        for i in [*np.flatnonzero(docs.is_valid().to_numpy(zero_copy_only=False)).tolist(), None]:
            stop = len(docs) if i is None else i
            ids += [told[a:b] for a, b in zip(ends[at:stop], ends[at + 1 : stop + 1], strict=True)]
            raw += pieces[at:stop]
            if i is not None:
                for row in _digests(docs[i].as_py(), ids, raw):
                    yield from out.add(row, 200)
                ids, raw, at = [], [], i + 1
    yield out.flush()
    del batches
    released()


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", stretch_bytes: int = STRETCH_BYTES) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text."""
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    words = rows.mapInArrow(_stretches(pattern, unknown_characters(), stretch_bytes), _ROWS)
    ids = words.select("word", "docs", encoded(F.col("word"), path).alias("ids"))
    done = ids.select("ids", decoded(F.col("ids"), path).alias("raw"), "docs").mapInArrow(_placed, _OUT)
    return done.select(F.col("key").cast(kind).alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")
