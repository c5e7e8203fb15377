import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.llm import variants as V
from tallymark.llm.queries import slips

SCHEMA = "doc_id long, text string, word string, n long, gram string, cell int, form string"


def apart(a, b):
    """Whether one character inserted, deleted or replaced makes b of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows, change=True):
    out = Counter()
    for doc_id, text, *_ in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            if change:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
                w = w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return out


def brute_force(counts, length=5, count=3):
    vocab = {w: n for w, n in counts.items() if len(w) >= length and n >= count}
    near = {w: [x for x in vocab if apart(w, x)] for w in vocab}
    form = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * n else None
    out = []
    for w, n in vocab.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), vocab[form[w]] if form[w] else None))
    return sorted(out)


def words(seed, many):
    """Words of few syllables, so that many are one edit apart, with their slips and letters beyond ASCII."""
    rng = random.Random(seed)
    base = ["".join(rng.choices(["an", "ta", "ma", "é", "ß", "÷", "tion", "x"], k=rng.randint(2, 6))) for _ in range(many)]
    base += [f"{'a' * k}" for k in range(3, 12)] + ["b" + "a" * 9, "a" * 9 + "b", "ab" * 6, "ba" * 6, "Über", "übers", "Übers"]
    out = []
    for w in base:
        out += [w] * rng.choice([1, 3, 3, 4, 9, 30])
        for _ in range(3):
            i, c = rng.randrange(len(w) + 1), rng.choice("aex")
            out += [rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])] * rng.choice([1, 3, 5])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("cell", [V.CELL, 3])
def test_variants_match_brute_force(spark, cell):
    """With cells of three rows nearly every gram is dealt over a grid."""
    own = words(4, 120)
    rows = [(i if i % 11 else None, " ".join(own[i::60]).replace("a", "A", i % 4) + (" 1" if i % 2 else ","), "w", 1, "g", 2, "f") for i in range(60)]
    rows += [(100, None, "w", 1, "g", 2, "f"), (101, "", "w", 1, "g", 2, "f"), (102, "long" * 5000 + " " + ("y" * 300 + " ") * 3 + "y" * 299, "w", 1, "g", 2, "f"), *[rows[3]] * 2]
    got = V.variants(V.word_counts(spark.createDataFrame(rows, SCHEMA), change=slips), cell=cell)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == brute_force(counted(rows))


@pytest.mark.parametrize("length", [2, 3, 4])
def test_short_words_find_their_neighbours(spark, length):
    rng = random.Random(length)
    counts = Counter("".join(rng.choices("abc", k=rng.randint(length, length + 3))) for _ in range(400))
    got = V.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), least_length=length, least_count=1)
    assert sorted(tuple(r) for r in got.collect()) == brute_force(counts, length, 1)
    with pytest.raises(ValueError):
        V.variants(got, least_length=1)


def test_an_empty_table_has_no_words(spark):
    assert V.variants(V.word_counts(spark.createDataFrame([], SCHEMA))).count() == 0


def test_questions_stay_until_their_postings_end(monkeypatch):
    """Slabs of seven rows cut the postings of one gram again and again."""
    monkeypatch.setattr(V, "SLAB", 7)
    own = sorted({w for w in words(9, 40) if 5 <= len(w) <= 7 and w.startswith("a")})
    rows = [("any", 0, j, i, 1, w) for i, w in enumerate(own) for j in range(4)] + [("any", 1, j, i, 1, w) for i, w in enumerate(own) for j in range(4, 6)]
    rows += [("any", 1, j, i, 1, w) for i, w in enumerate(own) for j in range(4)]
    names = ["gram", "side", "pos", "id", "n", "word", "cell"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] if k < 6 else 0 for r in rows[i : i + 5]], t) for k, t in enumerate(kinds)], names=names) for i in range(0, len(rows), 5)]
    got = {frozenset((p["word"], p["other"])) for b in V._merged(iter(batches)) for p in b.to_pylist()}
    assert got == {frozenset((a, b)) for a in own for b in own if apart(a, b)}


def test_every_meeting_happens_in_one_cell(spark):
    rows = spark.createDataFrame([("hot", i % 2, 0, i, 1, "w") for i in range(101)] + [("cold", 1, 0, 7, 1, "w")], V._POSTINGS)
    met = V.dealt(rows, cell=10)
    asked, found = met.where("side = 0"), met.where("side = 1")
    pairs = asked.alias("a").join(found.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.cell") == F.col("b.cell")))
    assert pairs.count() == 51 * 50 == pairs.select("a.id", "b.id").distinct().count()
    assert met.groupBy("gram", "cell", "side").count().agg(F.max("count")).first()[0] <= 30
