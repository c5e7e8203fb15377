import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passage(seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijkl", k=7)) for _ in range(n))


def frame(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def test_near_duplicates_decide_by_row(spark):
    a, b, c, d = map(passage, range(4))
    # rows of one id: one heads a group, another follows in a group of its own; null ids likewise
    docs = frame(spark, (1, a), (2, b), (3, a), (3, c), (5, b), (None, d), (None, a + " tail"), (9, d))
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted([("2", b), ("3", c), ("None", d), ("None", a + " tail")])


@pytest.mark.parametrize("who", [7, None])
def test_repeated_passages_keep_each_rows_own_text(spark, who):
    first, second, x, y = map(passage, range(10, 14))
    before = -5 if who else None
    docs = frame(spark, (before, first), (before, second), (who, f"{first} {x}"), (who, f"{second} {y}"), (8, f"{x} {y}"), (9, "short"))
    rows = corpus_pipeline.repeated_passages(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, (before, before, who, who, 8, 9)))
    # every passage stays once, in whichever of equal ids came first
    text = " ".join(r.text for r in rows)
    assert all(text.count(p) == 1 for p in (first, second, x, y)) and len(text.split()) == 161
    if who:
        assert {r.text for r in rows if r.doc_id == who} == {x, y}
    assert all(r.n_chars == len(r.text) for r in rows)
