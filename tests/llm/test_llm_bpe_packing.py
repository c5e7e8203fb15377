import hashlib
import json
import struct
import zlib
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallymark.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    None, "", "   ", "Hello, world!  it's 42", "I'm can't WE'LL <|endoftext|> x<|startoftext|>y", "a" * 300 + " " + "hahaha" * 50,
    "\x1c a\x1db \x85 q\xa0z ΑΣ İstanbul ǅ ﬁ é", "日本語 テスト 😀👍🏽 한국어", "word " * 9000,
]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("library", [False, True])
def test_ids_are_the_librarys(library):
    model = bpe.model(PATH, library)
    for text in TEXTS:
        assert model.encode(text) == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    assert bpe.model(PATH).encode(text) == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdehinorst", min_size=1, max_size=24))
def test_any_word_has_one_last_token_for_each_prefix(word):
    assert bpe.model(PATH).encode_word(word) == ids(word)


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, id string")


def test_encode_documents(spark):
    df = rows(spark, [*TEXTS, TEXTS[3]])
    got = {r.doc_id: r for r in bpe.encode_documents(df, PATH).collect()}
    for i, text in enumerate([*TEXTS, TEXTS[3]]):
        want = ids(text)
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0
    full = bpe.encode_documents(df.where("doc_id = 3"), PATH, with_ids=True).first()
    assert full.ids == ids(TEXTS[3])


def test_plan_holds_every_piece_once():
    histogram = {4096: 3, 4000: 2, 2048: 5, 96: 7, 1: 200, 3: 1}
    taken, used = {}, {}
    for length, rank, n, first, fit, at in packing.plan(histogram):
        for j in range(n):
            assert taken.setdefault((length, rank + j), True)
            used.setdefault(first + j // fit, []).append((at + j % fit * length, length))
    assert len(taken) == sum(histogram.values())
    for places in used.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= 4096
    total = sum(k * v for k, v in histogram.items())
    assert len(used) <= -(-total // 4096) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_is_best_fit_decreasing(histogram):
    room = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            best = min((r for r in room if r >= length), default=None)
            if best is None:
                room.append(40 - length)
            else:
                room[room.index(best)] -= length
    runs = packing.plan(histogram, 40)
    assert len({first + j // fit for _, _, n, first, fit, _ in runs for j in range(n)}) == len(room)


def test_pack_documents(spark):
    texts = [*TEXTS, None, TEXTS[3], TEXTS[3]]
    got = packing.pack_documents(rows(spark, texts), PATH).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    places = {}
    for i, text in enumerate(texts):
        want = [*ids(text), 1]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(want), 4096)) and sum(r.length for r in own) == len(want)
        for r in own:
            part = want[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 4096
    assert packing.pack_documents(rows(spark, texts).limit(0), PATH).count() == 0


def test_two_vocabularies_in_one_worker(spark, tmp_path):
    spec = json.load(open(PATH))
    spec["model"]["merges"] = spec["model"]["merges"][: len(spec["model"]["merges"]) // 8]
    other = str(tmp_path / "other.json")
    with open(other, "w") as f:
        json.dump(spec, f)
    df = rows(spark, TEXTS).coalesce(1)
    for path in (PATH, other, PATH):
        library = Tokenizer.from_file(path)
        got = {r.doc_id: list(r.ids) for r in packing.pack_documents(df.where("doc_id < 8"), path, with_ids=True).collect()}
        assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, packing.END] for i, t in enumerate(TEXTS[:8])}


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_BYTES", 2000)
    model = bpe.LibraryBPE(PATH)
    text = " ".join(f"word{i} x{i % 3}" for i in range(200))
    assert b"".join(model.packed(text)) == array("I", ids(text)).tobytes() and model._held <= 2000
