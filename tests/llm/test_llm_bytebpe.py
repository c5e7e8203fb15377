import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallymark.llm import bytebpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, word string, docs int, ids string, key string, raw long"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bytebpe.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(11)
    kinds = ["abcdefghij", "aAbB'st  \n\t", "äöüßéñ çÇ", "日本語テキスト中文", "кириллица ", "0123456789٣四", "…—!?.,;:'\"()-", "̀‍🙂👩\x00\x1c\x85\xa0 ", "\U00016ea0՘꟏\U000323b0a1"]
    out = ["".join(rng.choices("".join(rng.sample(kinds, rng.randint(1, 4))), k=rng.randint(1, 120))) for _ in range(150)]
    out += [None, "", " ", "   ", "\n\n \n", "it's we'll I'D <|endoftext|>", "a" * 5000, "ab" * 2000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3000)), " " * 3000, "=" * 999, "日本" * 700]
    return [*out, *out[:5], " ".join(rng.choices(["the", "quick", "żółw", "naïve", "x1y2"], k=60_000))]


def test_ids_and_bytes_are_the_librarys(spark, library):
    rows = [(i if i % 9 else None, t, "w", 1, "i", "k", 2) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    for most in (bytebpe.STRETCH_BYTES, 2000):  # one stretch a task, and many
        got = bytebpe.encode_documents(df, PATH, PATTERN, stretch_bytes=most)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_empty_table(spark):
    assert bytebpe.encode_documents(spark.createDataFrame([], SCHEMA), PATH, PATTERN).count() == 0


def test_decoding_joins_pieces(spark, library):
    ids = library.encode_ordinary("żółw 🙂 1234 \x00")
    row = spark.createDataFrame([(ids,), ([],)], "ids array<int>").select(bytebpe.decoded(F.col("ids"), PATH).alias("raw")).collect()
    assert [bytes(r.raw) for r in row] == [library.decode_bytes(ids), b""]


def test_the_splitter_follows_the_librarys_classes():
    """Every character on its own and before a letter: cut as the library cuts it."""
    cut = bytebpe.splitter(PATTERN, bytebpe.unknown_characters())
    ask = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks={bytes([i]): i for i in range(256)} | {b"ab": 256, b"1b": 257, b"!b": 258}, special_tokens={})
    odd = [chr(c) for c in [*range(0x3000), *range(0xA700, 0xA800), *range(0x10500, 0x11F00, 3), *range(0x16E00, 0x16F00), *range(0x323A0, 0x323C0)] if not 0xD800 <= c < 0xE000]
    for c in odd:
        text = f"{c}ab1b!b{c}"
        own = cut(text)
        assert "".join(own) == text
        assert [x for w in own for x in ask._core_bpe.encode_single_piece(w.encode())] == ask.encode_ordinary(text)


def test_a_vocabulary_without_last_merges_is_refused(tmp_path):
    own = tmp_path / "odd.tiktoken"
    lines = [(bytes([i]), i) for i in range(256)] + [(b"abc", 256)]
    own.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in lines))
    with pytest.raises(ValueError, match="256"):
        bytebpe.tables(str(own))
    own.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in lines[1:]))
    with pytest.raises(ValueError):
        bytebpe.merges(bytebpe.read_ranks(str(own)))
