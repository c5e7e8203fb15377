import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallymark.llm import langid, toxicity
from tallymark.llm.common import lower_ascii, words

SF = "/root/testdata/sf0.001"


def shingles(text, n):
    own = words(lower_ascii(text)) if text else []
    return {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if len(own) >= n else ({tuple(own)} if own else set())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "x", 0), (10_002, "", None, "x", 0), (10_003, "1234 ??", "en", "x", 7)], docs.schema)
    docs = docs.unionByName(extra)
    out = corpus_pipeline.language(spark, docs, SF)
    assert out.schema == docs.schema
    of = langid.predictor(langid.fit(docs.select("doc_id", "text", "lang")))
    rows = docs.collect()
    kept = {r.doc_id for r in rows if of(r.text)[0] != "und" and of(r.text)[1] >= corpus_pipeline.LEAST_LANGUAGE}
    assert {r.doc_id for r in out.collect()} == kept and not kept & {10_001, 10_002, 10_003}
    docs = spark.createDataFrame(out.collect(), out.schema)

    out = corpus_pipeline.toxic(spark, docs, SF)
    score = toxicity.scorer(toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")))
    rows = docs.collect()
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in rows if score(r.text)[0] < corpus_pipeline.TOXIC}
    docs = spark.createDataFrame(out.collect(), out.schema)

    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    sets, parent = [shingles(r.text, 5) for r in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(out.collect()) == sorted(r for i, r in enumerate(rows) if root(i) == i)
    docs = spark.createDataFrame(out.collect(), out.schema)

    out = corpus_pipeline.repeated_passages(spark, docs, SF)
    assert out.columns == docs.columns
    got, seen = {r.doc_id: r for r in out.collect()}, set()
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        own = words(r.text)
        cut = [False] * len(own)
        for s in range(len(own) - 19):
            key = tuple(own[s : s + 20])
            if key in seen:
                cut[s : s + 20] = [True] * 20
            seen.add(key)
        text = " ".join(w for w, c in zip(own, cut) if not c) if any(cut) else r.text
        assert got[r.doc_id].text == text and got[r.doc_id].n_chars == (len(text) if any(cut) else r.n_chars)
    docs = spark.createDataFrame(out.collect(), out.schema)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {}
    for r in corpus_pipeline.pack(spark, docs, SF).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
