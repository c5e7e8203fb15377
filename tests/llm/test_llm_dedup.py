import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallymark.llm import chunks as C
from tallymark.llm.common import lower_ascii, words
from tallymark.llm.components import components
from tallymark.llm.jaccard import linked_components
from tallymark.llm.katz import FEW, HELD, Model, Statistics, good_turing
from tallymark.llm.substrings import dedup_substrings

SCHEMA = "doc_id long, text string, node string, n long"


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 150))) for _ in range(60)]
    passage = " ".join(rng.choices(vocab, k=70))
    out = list(base)
    for t in base[:25]:  # near copies
        w = t.split()
        for _ in range(3):
            own = list(w)
            for _ in range(max(1, len(own) // 60)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            out.append(" ".join(own))
    out += [passage + " " + t for t in base[30:40]] + [base[0]] * 4 + [passage[: len(passage) // 2].upper()]
    out += [None, "", " \t\n", "one", "one two", "ONE TWO", "one two three", "x " * 300, "x\x1cy a\xa0b\x85"]
    rng.shuffle(out)
    rows = [(i * 3 + 5, t, "?", None) for i, t in enumerate(out)]
    return [*rows, (None, base[1], "?", None), (None, None, "?", None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("bits", [64, 12])
def test_substrings_match_brute_force(spark, bits):
    """With 12 bits nearly all proposals collide, and words decide."""
    rows = corpus()
    got = {r.doc_id: r for r in dedup_substrings(frame(spark, rows), with_text=True, hash_bits=bits).collect() if r.doc_id is not None}
    seen = set()
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = words(text)
        cut = [False] * len(own)
        for s in range(len(own) - 19):
            key = tuple(own[s : s + 20])
            if key in seen:
                cut[s : s + 20] = [True] * 20
            seen.add(key)
        if doc_id is None:
            continue
        kept = " ".join(w for w, c in zip(own, cut) if not c)
        r = got[doc_id]
        assert (r.n_words, r.n_removed, r.kept_text) == (len(own), sum(cut), kept)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert sum(r.n_removed for r in got.values()) > 500


def test_windows_that_equal_other_places_than_the_leader(spark):
    """Ten contexts of one seed phrase, each twice: only the second of each goes, and whole."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=9))
    phrase = " ".join(word() for _ in range(10))
    contexts = [f"{' '.join(word() for _ in range(15))} {phrase} {' '.join(word() for _ in range(15))}" for _ in range(10)]
    rows = [(i, t, "", None) for i, t in enumerate(contexts)] + [(20 + i, f"{word()} {t} {word()}", "", None) for i, t in enumerate(contexts)]
    rows += [(40, " ".join(contexts[3].split()[8:]), "", None), (41, "z " * 100, "", None), (42, phrase, "", None)]
    got = {r.doc_id: r.n_removed for r in dedup_substrings(frame(spark, rows)).collect()}
    assert got == {**{i: 0 for i in range(10)}, **{20 + i: 40 for i in range(10)}, 40: 32, 41: 99, 42: 0}


def test_substrings_of_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"q{i}" for i in range(30))
    got = dedup_substrings(frame(spark, [(7, text, "", None)] * 2 + [(9, text, "", None)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(7, 0), (7, 0), (9, 30)]
    assert dedup_substrings(frame(spark, [])).count() == 0


def shingles(text, n):
    own = words(lower_ascii(text)) if text else []
    return {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if len(own) >= n else ({tuple(own)} if own else set())


@pytest.mark.parametrize(("n", "t"), [(3, 90), (5, 80), (1, 75)])
def test_components_match_brute_force(spark, n, t):
    rows = corpus(n)
    sets = [shingles(r[1], n) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= t * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    lowest = defaultdict(list)
    for i, r in enumerate(rows):
        lowest[root(i)] += [r[0]] if r[0] is not None else []
    want = Counter((r[0], len(sets[i]), min(lowest[root(i)], default=None)) for i, r in enumerate(rows))
    got = Counter(tuple(r) for r in linked_components(frame(spark, rows), n, t).select("doc_id", "n_shingles", "component_id").collect())
    assert got == want
    assert len({root(i) for i in range(len(rows))}) < len(rows) - 20


def test_jaccard_of_empty_tables_and_bad_parameters(spark):
    assert linked_components(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        linked_components(frame(spark, []), 3, 50)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_good_turing_stays_between_zero_and_the_count():
    for counts in ([0, 100, 40, 20, 12, 8, 5, 0], [0, 1, 9, 0, 3, 0, 0, 0], [0] * 8):
        values = good_turing(np.array(counts))
        assert all(0 < values[r] <= r for r in range(1, FEW + 1))


@pytest.mark.parametrize("order", [2, 3])
def test_katz_matches_brute_force_and_sums_to_one(spark, order):
    rows = [r for r in corpus(9) if r[0] is not None]
    docs = frame(spark, rows)
    model = Model(docs, train=docs["doc_id"] % 7 != 0, order=order)
    got = {r.doc_id: r for r in model.score().collect()}
    texts = {r[0]: words(lower_ascii(r[1] or "")) + ["</end>"] for r in rows}
    train = [i for i in texts if i % 7]
    grams = {m: Counter() for m in range(1, order + 1)}
    heads = Counter()
    for i in train:
        for k, w in enumerate(texts[i]):
            before = (["<begin>"] * order + texts[i][:k])[-(order - 1) :]
            for m in range(1, order + 1):
                h = tuple(before[len(before) - m + 1 :])
                grams[m][(*h, w)] += 1
                if m > 1:
                    heads[h] += 1

    def several(counter):
        out = np.zeros(FEW + 3, int)
        for v in counter.values():
            out[min(v, FEW + 2)] += 1
        return out

    single = Counter({k[0]: v for k, v in grams[1].items()})
    total = sum(single.values())
    stats = Statistics.of({m: several(g) for m, g in grams.items()}, total, len(single), len(train))
    p1 = {w: float(stats.word(np.array([c]))[0]) for w, c in single.items()}
    assert abs(sum(p1.values()) + stats.unknown - 1) < 1e-9 and stats.unknown > 0
    after = defaultdict(dict)
    for m in range(2, order + 1):
        for g, c in grams[m].items():
            after[g[:-1]][g[-1]] = float(stats.discounted(m, np.array([c]))[0]) / (heads[g[:-1]] + HELD)
    alpha = {}

    def p(h, w):
        if not h:
            return p1.get(w, stats.unknown)
        if h not in after:
            return p(h[1:], w)
        return after[h][w] if w in after[h] else alpha[h] * p(h[1:], w)

    for h in sorted(after, key=len):
        alpha[h] = (1 - sum(after[h].values())) / (1 - sum(p(h[1:], w) for w in after[h]))
    for h in [h for h in after if len(h) == order - 1][:20]:  # every context sums to one over all known words and the unknown one
        assert abs(sum(p(h, w) for w in p1) + p(h, "never seen") - 1) < 1e-9
    for i, own in texts.items():
        score = sum(math.log10(p(tuple((["<begin>"] * order + own[:k])[-(order - 1) :]), w)) for k, w in enumerate(own))
        r = got[i]
        base = sum(math.log10((single.get(w, 0) + 0.1) / (total + 0.1 * (len(single) + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in single for w in own), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    held = [i for i in texts if i % 7 == 0]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
    # the stored tables: distinct n-grams with their counts by order, weights of all contexts
    stored = {m: [r for r in model.counts.where(f"kind = {-m}").collect()] for m in grams}
    for m, g in grams.items():
        assert sum(len(C.unpack_keys(bytes(r["keys"]))) for r in stored[m] if r["keys"]) == len(g)
        assert sorted(c for r in stored[m] if r["counts"] for c in C.from_planes(bytes(r["counts"]), "<u4").tolist()) == sorted(g.values())
    kept = [x for r in model.weights.where("kind < 0").collect() for x in C.from_planes(bytes(r["weights"]), "<f4").tolist()]
    assert sorted(kept) == pytest.approx(sorted(math.log10(a) for a in alpha.values()), rel=1e-4, abs=1e-5)


def test_katz_of_odd_tables(spark):
    assert Model(frame(spark, [])).score().count() == 0
    rows = frame(spark, [(None, "a b a b", "", None), (None, None, "", None), (4, "a b", "", None), (4, "a b", "", None)])
    got = Model(rows).score().collect()
    assert sorted(r.n_tokens for r in got) == [1, 3, 3, 5] and all(r.score < 0 for r in got)


def test_only_a_to_z_are_lower_cased():
    from tallymark.llm.common import lower_ascii

    assert [lower_ascii(t) for t in ("", "AZ[a", "ÄÉAZİẞ ΣB", "日本X\x00")] == ["", "az[a", "ÄÉazİẞ Σb", "日本x\x00"]


def test_whole_sets_are_compared_without_batches_of_them(spark, monkeypatch):
    """Sets of candidates stay in the join's rows, and tasks hand their memory back."""
    from tallymark.llm import common, jaccard

    plans, kept = [], jaccard.staged

    def seen(df, name, *more):
        if name == "links":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name, *more)

    monkeypatch.setattr(jaccard, "staged", seen)
    rows = [(i, " ".join(f"w{k}" for k in range(100) if k != i), "", None) for i in range(3)]
    assert {r.component_id for r in linked_components(frame(spark, rows), t100=80).collect()} == {0}
    assert plans
    assert not any("InPandas" in p or "InArrow" in p for p in plans)
    calls = []
    monkeypatch.setattr(common, "released", lambda: calls.append(1))
    assert list(common.handing_back(iter)([1, 2])) == [1, 2]
    assert calls == [1]


def test_signatures_come_in_slices(spark):
    from tallymark.llm import jaccard

    rows = [(i, i, np.arange(i * 40, i * 40 + 40, dtype="<u8").tobytes(), None if i % 7 == 0 else i) for i in range(1, 2 * jaccard.SLICE)]
    classes = spark.createDataFrame(rows, "node long, n long, prefix binary, rep long").coalesce(1)
    got = [tuple(r) for r in jaccard.signatures(classes.withColumn("n", jaccard.F.lit(150).cast("long")), 1, 80).collect()]
    want = {(int(e), node, 150, rep) for node, _, prefix, rep in rows for e in np.frombuffer(prefix, "<u8")[: jaccard.prefix_length(150, 80) + 1]}
    assert set(got) == want and len(got) == len(want)
