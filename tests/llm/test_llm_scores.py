"""Scores of both classifiers against plain Python: language models learnt by hand, toxic windows one by one."""

import math
import zlib
from collections import Counter

import pytest

from tallymark.llm import langid, toxicity
from test_llm_classifiers import corpus


def own_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            out += [word] if len(word) <= 64 else [word[i : i + 16] for i in range(0, len(word) - 4, 12)]
            word = ""
    return out


def own_grams(word, n):
    marked = word if n == 1 else f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def learnt(rows):
    """Decades under 1 of every word (0) and n-gram in each language."""
    counts = {}
    for _, text, lang, *_ in rows:
        if text is not None and lang is not None:
            for w in own_words(text):
                counts.setdefault((lang, 0), Counter())[w] += 1
                for n in range(1, 6):
                    counts.setdefault((lang, n), Counter()).update(own_grams(w, n))
    langs = sorted({lang for _, _, lang, *_ in rows if lang is not None})
    tables = [{} for _ in range(6)]
    for (lang, n), tally in counts.items():
        total = sum(tally.values())
        for entry, k in tally.items():
            tables[n].setdefault(entry, dict.fromkeys(langs, 7.0))[lang] = min(7.0, -math.log10(k / total))
    return langs, tables


def language(langs, tables, text):
    costs = []
    for w in own_words(text):
        found = [tables[0][w]] if w in tables[0] else []
        for n in range(5, 0, -1):
            if not found:
                found = [tables[n][g] for g in own_grams(w, n) if g in tables[n]]
        if found:
            costs.append({lang: sum(f[lang] for f in found) / len(found) for lang in langs})
    if not costs:
        return None
    mean = {lang: sum(c[lang] for c in costs) / len(costs) for lang in langs}
    best = min(langs, key=lambda lang: (mean[lang], lang))
    return best, 1 / sum(10 ** (mean[best] - m) for m in mean.values())


def test_languages_against_plain_python(spark):
    rows, _ = corpus(n=150)
    rows += [(900, "the½thing x²", "en", "s", 0), (901, "über" * 30, "de", "s", 0), (902, "x" * 65 + " oué", "fr", "s", 0)]
    asked = [*rows, (950, "thequeation unglich zzzq", None, "s", 0), (951, "ÉÀ oùé", None, "s", 0)]
    schema = "doc_id long, text string, lang string, source string, score long"
    model = langid.fit(spark.createDataFrame(rows, schema), most_docs=10_000)
    langs, tables = learnt(rows)
    got = langid.predict(spark.createDataFrame([(i, r[1]) for i, r in enumerate(asked)], "doc_id long, text string"), model).collect()
    told = 0
    for r in got:
        want = language(langs, tables, asked[r.doc_id][1])
        if want is None:
            assert r.lang_pred in ("und", model.commonest)
        else:
            told += 1
            assert r.lang_pred == want[0] and r.score == pytest.approx(want[1], rel=1e-4)
    assert told > 150


def toxic_score(model, text):
    """The strongest window, word by word and n-gram by n-gram."""
    values = []
    for w in toxicity.tokens(text):
        raw = f"<{w}>"
        places = [zlib.crc32(raw.encode())] + [zlib.crc32(raw[i : i + n].encode(), n) for n in (3, 4, 5) for i in range(len(raw) - n + 1)]
        values.append(sum(model.margins[p % len(model.margins)] for p in places) / len(places))
    if not values:
        best = min(model.bias, -0.01)
    else:
        windows = [values[i : i + 8] for i in range(0, max(1, len(values) - 4), 4)]
        best = max(sum(w) / max(len(w), 4) for w in windows) + model.bias
    return 1 / (1 + math.exp(-best))


def test_toxic_windows_against_plain_python(spark):
    rows, labels = corpus(n=120)
    make = spark.createDataFrame
    model = toxicity.fit(make([r[:2] for r in rows], "doc_id long, text string"), make(labels, "doc_id long, toxic int"))
    texts = [r[1] for r in rows] + ["one", "a b c", "w " * 5, "w " * 9, "moronic " * 13, "x" * 200, "MORONIC scumbag the thing"]
    got = toxicity.score(make(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(got) == len(texts)
    for r in got:
        want = toxic_score(model, texts[r.doc_id])
        assert r.score == pytest.approx(want, rel=1e-6, abs=1e-9) and r.predicted == int(r.score >= 0.5)
