"""Stages and operators on clashing columns, null and shared ids, empty tables; odd letters, archives and fragments."""

import gzip
import io
import json
import random
import struct
import zipfile

import public_tokenizers
import pytest

import corpus_pipeline
from tallymark.llm import bpe, langid, media, packing, substrings, warc
from test_llm_topk_media_warc import File, track

COLUMNS = ["_row", "_at", "_kept", "_TEXT", "_language", "_share", "_score", "__row"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in COLUMNS)
LABELS = "doc_id long, quality int, toxic int"


def words(seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijkl", k=7)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{c} {k}" for c in COLUMNS]) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    labels = [(i, 1, i % 2) for i in range(40)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    return str(at)


STAGES = [f for _, f in corpus_pipeline.STAGES]


@pytest.mark.parametrize("stage", STAGES, ids=lambda f: f.__name__)
def test_stages_on_clashing_columns_and_null_ids(spark, tables, stage):
    first, second = words(1), words(2)
    rows = [(None, first), (None, second), (None, None), (3, f"{first} {words(3)}"), (3, words(4)), (3, words(4)), (4, ""), (5, "x"), (6, words(5, 400))]
    docs = frame(spark, rows)
    out = stage(spark, docs, tables)
    got = out.collect()
    if stage is corpus_pipeline.pack:
        assert sum(r.doc_id is None for r in got) == 3 and sum(r.doc_id == 3 for r in got) == 3
        return
    assert out.columns == docs.columns and got
    by_row = {r["_row"]: r for r in docs.collect()}
    for r in got:  # what a stage doesn't decide about stays as it is, in its own row
        own = by_row[r["_row"]]
        assert all(r[c] == own[c] for c in [*COLUMNS, "doc_id", "lang", "source"])
        assert r.text == own.text or stage is corpus_pipeline.repeated_passages
    if stage is corpus_pipeline.repeated_passages:
        assert len(got) == len(rows)
        texts = {r["_row"]: r.text for r in got}
        assert texts["_row 0"] == first and texts["_row 3"] == words(3) and texts["_row 2"] is None and texts["_row 6"] == ""
    if stage is corpus_pipeline.near_duplicates:
        assert len(got) == len(rows) - 1  # one of the equal rows goes


@pytest.mark.parametrize("stage", STAGES, ids=lambda f: f.__name__)
def test_stages_on_an_empty_table(spark, tables, stage):
    docs = frame(spark, [])
    out = stage(spark, docs, tables)
    assert out.count() == 0
    assert stage is corpus_pipeline.pack or out.schema == docs.schema


def test_numbers_beyond_digits_are_no_letters(spark):
    model = langid.fit(spark.createDataFrame([(1, "the cat", "en")], "doc_id long, text string, lang string"))
    rows = [(1, "½"), (2, "²³ Ⅷ ①"), (3, "x²"), (4, "the½cat"), (5, "_ 12")]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["und", "und", "en", "en", "und"] and got[1].score == 0
    assert langid.letters("A½b ②") == ["a", "b"] and all(c.isalpha() for c in "".join(langid.letters("a٣b𝟙Ⅷⅷ")))


@pytest.mark.parametrize("who", [None, 7])
def test_languages_are_learnt_from_rows_that_share_an_id(spark, who):
    rng = random.Random(3)
    rows = [(who, " ".join(rng.choices(["les", "eaux", "nation"] if k % 2 else ["the", "water", "nation"], k=9)) + f" z{k}", "fr" if k % 2 else "en") for k in range(3_000)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_docs=50)
    assert {"les", "eaux", "the", "water"} <= set(model.words) and len(model.words) < 1_000


def test_a_sample_of_equal_rows_is_bounded(spark):
    rows = [(7, "the same " * 5, "en")] * 2_000 + [(8, "une autre", "fr")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_docs=10)
    assert model is not None and set(model.words) <= {"the", "same", "une", "autre"}


def test_fragments_after_long_heads_and_without_a_base():
    empty = [media._full(b"stsz", struct.pack(">II", 0, 0)), *(media._full(k, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco"))]
    trex = [media._full(b"trex", struct.pack(">IIIII", n, 1, 9, 4, 0)) for n in (1, 2)]
    head = media._box(b"moov", track(1, b"avc1", empty), track(2, b"mp4a", empty, b"soun"), media._box(b"mvex", *trex))
    for flags in (0, 0x20000):  # the second track's data begin where the first one's end, or at the fragment
        run = media._full(b"trun", struct.pack(">Ii", 2, 300), flags=0x1)
        second = media._full(b"trun", struct.pack(">Ii", 3, 16), flags=0x1)
        trafs = media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 1)), run) + media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 2), flags=flags), second)
        moof = struct.pack(">I4sQ", 1, b"moof", 16 + len(trafs)) + trafs  # a head with a length of 64 bits
        data = head + moof + media._box(b"mdat", b"\7" * 400)
        one, two = media.read_tracks(data)
        start = len(head)
        assert one.offsets.tolist() == [start + 300, start + 304]
        base = start if flags else start + 308
        assert two.offsets.tolist() == [base + 16, base + 20, base + 24]


def test_records_that_an_index_leaves_out_are_walked():
    for pack in (gzip.compress, bytes):
        parts = [pack(warc.record(i, f"u{i}", b"x" * i, "response", None)) for i in range(5)]
        starts = [sum(map(len, parts[:i])) for i in range(6)]
        name = "archive/a.warc.gz" if pack is gzip.compress else "archive/a.warc"
        for told in ([1], [0, 4], [2, 3], [], range(5)):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr(name, b"".join(parts))
                z.writestr("indexes/index.cdx", "\n".join(f"u 2020 {json.dumps({'offset': starts[i], 'length': len(parts[i]) - 4 * (pack is bytes), 'filename': 'a.warc'})}" for i in told))
            raw = out.getvalue()
            spans = warc.index(File(raw))
            assert [a for a, _ in spans] == [raw.index(parts[0]) + s for s in starts[:5]]


def test_members_of_one_name_in_two_folders():
    out, parts = io.BytesIO(), [gzip.compress(warc.record(i, f"u{i}", b"x" * i, "response", None)) for i in range(4)]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("one/a.warc.gz", b"".join(parts[:3]))
        z.writestr("two/a.warc.gz", parts[3])
        lines = [{"offset": 0, "length": len(parts[3]), "filename": "a.warc.gz"}, {"offset": 0, "length": len(parts[3]), "filename": "two/a.warc.gz"}]
        z.writestr("indexes/index.cdx", "\n".join(f"u 2020 {json.dumps(x)}" for x in lines))
    raw = out.getvalue()
    assert [raw[a : a + n] for a, n in warc.index(File(raw))] == parts


def test_special_tokens_of_any_form(tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": 60_000, "content": "[SEP]"})
    own = tmp_path / "own.json"
    own.write_text(json.dumps(spec), encoding="utf-8")
    model = bpe.PrefixBPE(str(own))
    assert 60_000 in model.encode("a[SEP]b <|endoftext|>") and 49_407 in model.encode("a[SEP]b <|endoftext|>")
    spec["added_tokens"][-1]["content"] = "two words"
    own.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe.PrefixBPE(str(own))


def test_pieces_of_one_id_are_ranked_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    rows = [(None if i % 3 else 7, "same text") for i in range(400)]
    got = packing.pack_documents(frame(spark, rows), public_tokenizers.path("word_bpe_49k.json"), capacity=30)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    place = {(r.sequence_id, r.offset) for r in got.collect()}
    assert len(place) == 400
    windows = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [row_number" in line]
    assert windows and all("salt" in line for line in windows)


def test_a_leader_asked_by_all_is_dealt_by_copy(spark, monkeypatch):
    """Without a broadcast the texts and the questions of one leader meet by leader and copy."""
    monkeypatch.setattr(substrings, "ASKED", 5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = spark.createDataFrame([(i, words(1)) for i in range(200)], "row long, text string")
        stretches = spark.createDataFrame([(i, 0, 20, 0, 0) for i in range(1, 200)], "row long, at int, n int, row0 long, at0 int")
        found = substrings._fetched(own, stretches)
        plan = found._jdf.queryExecution().executedPlan().toString()
        last = plan[: plan.index("SortMergeJoin") + 200]
        assert "copy" in last[last.index("SortMergeJoin") :]
        assert "hashpartitioning(row0" in plan and plan.count("hashpartitioning(row0#") >= 2 and ", copy#" in plan
        assert {(r.row, r.words) for r in found.collect()} == {(i, " ".join(words(1).split()[:20])) for i in range(1, 200)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
