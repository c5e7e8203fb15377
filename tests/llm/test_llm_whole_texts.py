import random

import numpy as np
from pyspark.sql import functions as F

from tallymark.llm import langid, toxicity
from tallymark.llm.common import cut


def test_training_sees_every_window(spark):
    rng = random.Random(4)
    known = ["".join(rng.choices("abcdefghijklm", k=6)) for _ in range(300)]
    n = 1500
    # where 80 windows, spread evenly, have nothing
    seen = {int(a) + k for a in toxicity.window_starts(n)[np.linspace(0, len(toxicity.window_starts(n)) - 1, 80).astype(int)] for k in range(toxicity.WIDTH)}
    gaps = [a for a in range(n - 4) if not seen & set(range(a, a + 4))]
    rows, labels = [], []
    for i in range(120):
        own = rng.choices(known, k=n)
        if i % 2:
            for a in rng.sample(gaps, 20):
                own[a : a + 4] = ["zwurgz"] * 4
        rows.append((i, " ".join(own)))
        labels.append((i, i % 2))
    rows += [(200, " ".join([*rng.choices(known, k=40), *["zwurgz"] * 4, *rng.choices(known, k=40)])), (201, " ".join(rng.choices(known, k=84)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), most_docs=1000)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs.where(F.col("doc_id") >= 200), model).collect()}
    assert got == {200: 1, 201: 0}


def test_pieces_of_long_runs_hold_all_ngrams():
    rng = random.Random(1)
    for n in (1, 16, 64, 65, 66, 75, 76, 77, 500, 1001):
        run = "".join(rng.choices("abcdef", k=n))
        for step, g in ((8, 9), (12, 5)):
            pieces = cut([run, "x"], step)
            assert pieces[-1] == "x" and (n > 64 or pieces[0] == run)
            assert {run[i : i + g] for i in range(n - g + 1)} == {p[i : i + g] for p in pieces for i in range(len(p) - g + 1)}


def test_runs_count_beyond_their_64th_character(spark):
    rng = random.Random(5)
    known = {"a": ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)], "b": ["".join(rng.choices("qrstuvwx", k=6)) for _ in range(60)]}
    rows = [(i, " ".join(rng.choices(known["ab"[i % 2]], k=40)) + (" zwurgz" * 4 if i % 4 < 2 else ""), "ab"[i % 2]) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clean = "".join(rng.choices(known["a"], k=12))
    change = clean + "".join(rng.choices(known["b"], k=60))
    model = langid.fit(docs)
    of = langid.predictor(model)
    assert of(clean)[0] == "a" and of(change)[0] == "b"
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(160)], "doc_id long, toxic int")
    score = toxicity.scorer(toxicity.fit(docs, labels))
    plain = "".join(rng.choices(known["a"], k=60))
    assert score(plain)[0] < 0.5 < score(plain[:72] + "zwurgz" * 6 + plain[72:])[0]
