"""Language ID by words first, then shorter and shorter character n-grams.

A word that the model knows is scored by its log frequency in each language; a language that
lacks it pays a fixed penalty. An unknown word falls back to its longest n-grams of which any
is known, then to shorter ones. A document's score in a language is the mean over its words,
and the best language wins. Scoring is one pass over the rows, without a shuffle.

The model comes from Spark aggregations over a bounded sample of labelled rows (about
``most_docs`` of each language, chosen by a hash of id and text, four times as many at most) and holds all words
and n-grams of these, so what is sent to executors is bounded by the sample.
Every document is scored over its whole text. A run of over 64 letters (unspaced text)
counts as its pieces of 16, in training too.

Defined results: null texts, texts without a letter, and all texts where nothing could be
learnt are ``und`` with score 0; a text with letters of which nothing is known gets the most
frequent language and, as its score, one part in so many languages; equal languages go to the
smaller name; rows without a language teach nothing; repeated rows count as often as they stand there.
Null ids are kept and may teach; an empty table gives no rows; ``with_languages`` keeps all columns and
refuses a new name that is taken, ``predict`` leaves other columns out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.apply import appended
from tallymark.llm.common import cut

#: A word: a run of letters.
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: Decades that an unseen entry lies under the rarest one.
PENALTY = 7.0
UNKNOWN = "und"
MOST_KEPT = 150_000


def letters(text: str | None) -> list[str]:
    """Words; a run over 64 letters counts as its pieces, which share ends, so that every n-gram is in one."""
    own = LETTERS.findall(text.lower()) if text else []
    if not all(map(str.isalpha, own)):  # numbers beyond the digits, as in fractions or circled ones
        own = [part for w in own for part in "".join(c if c.isalpha() else " " for c in w).split()]
    return cut(own, 16 - LONGEST + 1)


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with its ends marked; an end alone is no n-gram."""
    marked = word if n == 1 else f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    #: entries: row of costs (decades under 1, one for each language); n-grams by length.
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    costs: np.ndarray
    #: The language with most labelled rows.
    commonest: str = ""

    def word_cost(self, word: str) -> np.ndarray | None:
        row = self.words.get(word)
        if row is not None:
            return self.costs[row]
        for n in range(LONGEST, 0, -1):
            known = [r for g in grams(word, n) if (r := self.grams[n].get(g)) is not None]
            if known:
                return self.costs[known].mean(0)
        return None


def fit(documents: DataFrame, keep: Column | None = None, most_docs: int = 400) -> Model | None:
    """Learn from rows with text and lang; ``keep`` says which rows may be used."""
    known = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    if keep is not None:
        known = known.where(keep)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not counts:
        return None
    part = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most_docs / n))])
    sample = known.where(F.pmod(F.xxhash64(F.lit(29), "doc_id", "text"), F.lit(1 << 20)) < part[F.col("lang")] * (1 << 20)).select("lang", "text")
    if sample.select("lang").count() > (most := 4 * most_docs * len(counts)):  # many rows equal in id and text
        sample = sample.limit(most)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for w in letters(text.as_py()):
                    tally[lang, w] = tally.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in tally], "entry": [k[1] for k in tally], "n": list(tally.values())}, pa.schema([("lang", pa.string()), ("entry", pa.string()), ("n", pa.int64())]))

    words = sample.select("lang", "text").mapInArrow(words_of, "lang string, entry string, n long").groupBy("lang", "entry").agg(F.sum("n").alias("n"))

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[str, int, str], int] = {}
            for lang, word, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n in range(1, LONGEST + 1):
                    for g in grams(word, n):
                        tally[lang, n, g] = tally.get((lang, n, g), 0) + count
            yield pa.RecordBatch.from_pydict(
                {"lang": [k[0] for k in tally], "size": [k[1] for k in tally], "entry": [k[2] for k in tally], "n": list(tally.values())},
                pa.schema([("lang", pa.string()), ("size", pa.int32()), ("entry", pa.string()), ("n", pa.int64())]),
            )

    chunks = words.select("lang", "entry", "n").mapInArrow(grams_of, "lang string, size int, entry string, n long").groupBy("lang", "size", "entry").agg(F.sum("n").alias("n"))
    table = words.select("lang", F.lit(0).alias("size"), "entry", "n").unionByName(chunks)
    totals = table.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    rows = table.join(F.broadcast(totals), ["lang", "size"]).select("lang", "size", "entry", "n", "total").toArrow()  # totals: six for each language; rows: bounded by the sample
    languages = sorted(counts)
    at = {lang: i for i, lang in enumerate(languages)}
    tables: dict[int, dict[str, int]] = {n: {} for n in range(LONGEST + 1)}
    cells: list[tuple[int, int, float]] = []
    n_rows = 0
    for batch in rows.to_batches(max_chunksize=10_000):
        for lang, size, entry, n, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            entries = tables[size]
            if entry not in entries:
                entries[entry] = n_rows
                n_rows += 1
            cells.append((entries[entry], at[lang], -np.log10(n / total)))
    costs = np.full((n_rows, len(languages)), PENALTY, np.float32)
    if cells:
        row, col, value = zip(*cells, strict=True)
        costs[row, col] = np.minimum(value, PENALTY)
    return Model(languages, tables.pop(0), tables, costs, max(languages, key=lambda x: (counts[x], [-ord(c) for c in x])))


def predictor(model: Model | None):
    """A function from whole texts to (language, score); words met before keep their costs."""
    kept: dict[str, int] = {}
    rows = np.zeros((MOST_KEPT, len(model.languages)), np.float32) if model else None

    def of(text: str | None) -> tuple[str, float]:
        if model is None:
            return UNKNOWN, 0.0
        total, n, at = np.zeros(len(model.languages)), 0, []
        own = letters(text)
        for w in own:
            k = kept.get(w)
            if k is None:
                if len(kept) >= MOST_KEPT:
                    total += rows[at].sum(0, dtype=np.float64)
                    n += len(at)
                    at.clear()
                    kept.clear()
                cost = model.word_cost(w)
                k = kept[w] = -1 if cost is None else len(kept)
                if cost is not None:
                    rows[k] = cost
            if k >= 0:
                at.append(k)
        if at:
            total += rows[at].sum(0, dtype=np.float64)
            n += len(at)
        if not n:
            return (model.commonest, 1 / len(model.languages)) if own else (UNKNOWN, 0.0)
        mean = total / n
        best = int(mean.argmin())
        return model.languages[best], float(1 / (10.0 ** (mean[best] - mean)).sum())

    return of


def with_languages(documents: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The rows with all their columns, their language, and its share in a softmax of the mean word scores."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    return appended(documents, text_col, lambda: predictor(shared.value), f"`{lang_col}` string, `{score_col}` double")


def predict(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred and score."""
    return with_languages(documents.select(id_col, text_col), model, text_col).select(id_col, "lang_pred", "score")
