import random

import pytest
from pyspark.sql import functions as F

from tallymark.llm import langid, toxicity

STEMS = {"en": ["the", "thing", "ation", "ough", "ing"], "de": ["der", "ung", "lich", "sch", "keit"], "fr": ["les", "eaux", "tion", "oué", "que"]}


def word(rng, lang):
    return "".join(rng.choices(STEMS[lang], k=rng.randint(1, 3)))


def corpus(seed=2, n=240):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        own = [word(rng, lang) for _ in range(rng.randint(12, 80))]
        toxic = i % 4 == 0
        if toxic:
            bad = ["moronic", "moroon", "morronic", "scumbag", "scumbags"] if i % 8 else ["moronik", "scuumbag", "xmoronic"]
            for _ in range(4):
                own.insert(rng.randrange(6), rng.choice(bad))
        rows.append((i, " ".join(own), lang if i % 9 else None, "s", 0))
        labels.append((i, int(toxic)))
    rows += [(n, None, "en", "s", 0), (n + 1, "", "en", "s", 0), (n + 2, "12 34 !!", None, "s", 0), (None, "the thing", "en", "s", 0), (3, rows[3][1], None, "s", 0), (n + 3, "the " * 30_000, None, "s", 0), (n + 4, "日本", None, "s", 0)]
    labels += [(n + 50, 1), (None, 1), (0, 0), (1, None)]
    return rows, labels


def frames(spark, n=240):
    rows, labels = corpus(n=n)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long"), dict(reversed(labels)), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_languages_of_unseen_documents(spark):
    rows, docs, _, _ = frames(spark)
    model = langid.fit(docs.drop("score"), keep=F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect() if r.doc_id is not None}
    held = [r for r in rows[:240] if r[0] % 3 == 0 and r[2]]
    right = sum(got[r[0]].lang_pred == r[2] for r in held)
    assert right / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    for i in (240, 241, 242):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[243].lang_pred == "en"
    assert got[244].lang_pred == model.commonest and got[244].score == pytest.approx(1 / 3)  # letters, all unknown


def test_unknown_words_fall_back_to_their_longest_known_grams():
    import numpy as np

    model = langid.Model(["a", "b"], {"known": 0}, {n: {} for n in range(1, 6)} | {3: {"zzz": 1}, 1: {"z": 2}}, np.array([[1, 5], [2, 3], [9, 1]], np.float32))
    assert model.word_cost("known").tolist() == [1, 5]
    assert model.word_cost("qzzzq").tolist() == [2, 3]
    assert model.word_cost("qzq").tolist() == [9, 1]
    assert model.word_cost("q") is None


def test_nothing_to_learn_languages_from(spark):
    _, docs, _, _ = frames(spark)
    assert langid.fit(docs.where("doc_id < 0")) is None
    got = langid.predict(docs, None).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in got] == [("und", 0.0)]
    assert langid.predict(docs.limit(0), None).count() == 0


def test_extra_columns_stay_and_clashes_are_told(spark):
    _, docs, _, _ = frames(spark)
    kept = langid.with_languages(docs, None, lang_col="_l", score_col="_s")
    assert kept.columns == [*docs.columns, "_l", "_s"] and kept.drop("_l", "_s").exceptAll(docs).count() == 0
    with pytest.raises(ValueError):
        langid.with_languages(docs, None)


def test_unseen_misspellings_are_toxic(spark):
    rows, docs, truth, labels = frames(spark, 480)
    train = F.col("doc_id") % 8 != 0  # the misspellings of every eighth row are never seen
    model = toxicity.fit(docs, labels, keep=train)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect() if r.doc_id is not None}
    caught = [got[i].predicted for i in range(0, 480, 8)]
    clean = [got[i].predicted for i in range(480) if i % 4]
    assert sum(caught) >= 0.9 * len(caught) and sum(clean) <= 0.03 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[480].predicted == got[481].predicted == 0


def test_labels_of_one_class_teach_nothing(spark):
    _, docs, _, labels = frames(spark)
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert toxicity.score(docs, None).select("score", "predicted").distinct().collect()[0][:] == (0.0, 0)
    assert toxicity.score(docs.limit(0), None).count() == 0
