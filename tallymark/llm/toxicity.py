"""Toxicity scores: subword bags averaged into a linear softmax, trained jointly in numpy.

A word is the average of its own vector and those of its character n-grams, all in one hashed
table, so that a misspelling never seen shares most of its vectors with the word it comes
from. A window of words is the average of its words, and a two-class softmax reads it. A
document is as toxic as its most toxic window. Vectors and softmax are learnt together: first
with all windows of a document under its label, then with its strongest window alone, so that
the clean passages of a toxic document aren't held against their words.

Only the training rows are sampled: about ``most_docs`` labelled documents of each class, each
with all its windows. Tasks send a document's distinct words once and its words as codes; the
windows are places in these, read in blocks. Every document is scored over all its words. A run
of over 64 characters (unspaced text) counts as its pieces of 16, one every 8, in both. The model is a table of one number per hashed n-gram, of fixed size.

Defined results: null and empty texts get the score of an empty window, which is the model's
base rate held under 0.5; repeated labels of a document count as their largest; labels
without a document and null labels are left out; without labels of both classes every score
is 0.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.apply import appended
from tallymark.llm.common import Batcher, cut

TOKEN = re.compile(r"\w+")
BUCKETS, DIM = 1 << 16, 8
GRAMS = (3, 4, 5)
WIDTH, STRIDE = 8, 4
DECAY = 2e-2
MOST_KEPT = 150_000
#: Windows that training reads at a time.
BLOCK = 1 << 15


def tokens(text: str | None) -> list[str]:
    """Words; a run over 64 characters counts as its pieces, of which one holds any 9 characters of it."""
    return cut(TOKEN.findall(text.lower()), 8) if text else []


def buckets(word: str) -> list[int]:
    """Hashed places of a word and of its character n-grams."""
    raw = f"<{word}>"
    out = [zlib.crc32(raw.encode())]
    for n in GRAMS:
        out += [zlib.crc32(raw[i : i + n].encode(), n) for i in range(len(raw) - n + 1)]
    return [x % BUCKETS for x in out]


def window_starts(n: int) -> np.ndarray:
    return np.arange(0, max(1, n - WIDTH + STRIDE), STRIDE)


@dataclass
class Model:
    """What scoring needs: softmax margin of each hashed n-gram, and of the bias."""

    margins: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return float(self.margins[buckets(word)].mean())

    def window_margins(self, words: np.ndarray) -> np.ndarray:
        """Margins of all windows of a document, from its words' margins."""
        n = len(words)
        if not n:
            return np.array([min(self.bias, -0.01)])
        sums = np.concatenate(([0.0], np.cumsum(words)))
        at = window_starts(n)
        end = np.minimum(at + WIDTH, n)
        return (sums[end] - sums[at]) / np.maximum(end - at, STRIDE) + self.bias


def train(docs: list[tuple[list[str], np.ndarray]], labels: np.ndarray, prior: float = 0.5, epochs: int = 24, warm: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Fit vectors and softmax to documents given as distinct words and the codes of all words, with labels 0 or 1.

    ``prior`` is the share of label 1 outside the sample; it weights the two classes.
    """
    vocab: dict[str, int] = {}
    word_ids = np.concatenate([np.array([vocab.setdefault(x, len(vocab)) for x in own], np.int32)[codes] for own, codes in docs])
    sizes = [len(codes) for _, codes in docs]
    gram_ids, gram_len = array("H"), array("i")  # BUCKETS fit 16 bits
    for w in vocab:
        own = buckets(w)
        gram_ids.extend(own)
        gram_len.append(len(own))
    gram_ids, gram_len = np.frombuffer(gram_ids, np.uint16), np.frombuffer(gram_len, np.int32)
    gram_at = np.concatenate(([0], np.cumsum(gram_len)[:-1]))
    starts = [window_starts(n).astype(np.int32) for n in sizes]
    doc_len = np.array([len(x) for x in starts])
    of_doc = np.repeat(np.arange(len(docs), dtype=np.int32), doc_len)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    window_at = np.concatenate([x + a for x, a in zip(starts, begins, strict=True)])
    window_len = np.concatenate([np.minimum(WIDTH, n - x) for x, n in zip(starts, sizes, strict=True)])
    doc_at = np.concatenate(([0], np.cumsum(doc_len)[:-1]))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft, bias = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    seen, seen_soft, seen_bias = np.full((BUCKETS, DIM), 1e-3), np.full((DIM, 2), 1e-3), np.full(2, 1e-3)

    def flat(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of some windows, and the place in ``chosen`` of each one's window."""
        n = window_len[chosen]
        at = np.repeat(window_at[chosen] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return word_ids[at], np.repeat(np.arange(len(chosen)), n)

    def word_values(of_bucket: np.ndarray) -> np.ndarray:
        return np.add.reduceat(of_bucket[gram_ids], gram_at) / gram_len

    for epoch in range(epochs):
        margin = soft[:, 1] - soft[:, 0]
        if epoch < warm:
            chosen, weight_of = np.arange(len(window_at)), 1.0 / doc_len
        else:  # the strongest window of every document, and another of each clean one
            values, scores = word_values(table @ margin), np.empty(len(window_at))
            for a in range(0, len(window_at), BLOCK):
                own = np.arange(a, min(a + BLOCK, len(window_at)))
                words, row = flat(own)
                scores[own] = np.bincount(row, values[words], len(own)) / np.maximum(window_len[own], STRIDE)
            hits = np.flatnonzero(scores == np.maximum.reduceat(scores, doc_at)[of_doc])
            chosen = np.empty(len(docs), np.int64)
            chosen[of_doc[hits]] = hits  # the last of equal ones stays
            clean = np.flatnonzero(labels == 0)
            chosen = np.concatenate((chosen, doc_at[clean] + rng.integers(0, doc_len[clean])))
            weight_of = np.ones(len(docs))
        of_label = np.bincount(labels[of_doc[chosen]], weight_of[of_doc[chosen]], 2)
        scale = np.array([1 - prior, prior]) / np.maximum(1, of_label) * len(docs)
        vectors = np.column_stack([word_values(table[:, d]) for d in range(DIM)])
        to_word, to_soft, to_bias = np.zeros((len(vocab), DIM)), np.zeros((DIM, 2)), np.zeros(2)
        for a in range(0, len(chosen), BLOCK):
            own = chosen[a : a + BLOCK]
            y, size = labels[of_doc[own]], np.maximum(window_len[own], STRIDE)[:, None]  # as in scoring: a short window isn't worth a full one
            # forward: windows as averages of words, words as averages of n-grams
            words, row = flat(own)
            hidden = np.column_stack([np.bincount(row, vectors[words, d], len(own)) for d in range(DIM)]) / size
            logits = hidden @ soft + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            g = p * (scale[y] * weight_of[of_doc[own]])[:, None]
            # backward
            back = g @ soft.T / size
            for d in range(DIM):
                to_word[:, d] += np.bincount(words, back[row, d], len(vocab))
            to_soft += hidden.T @ g
            to_bias += g.sum(0)
        to_word /= gram_len[:, None]
        to_table = np.column_stack([np.bincount(gram_ids, np.repeat(to_word[:, d], gram_len), BUCKETS) for d in range(DIM)]) + DECAY * table
        for value, grad, past in ((table, to_table, seen), (soft, to_soft + DECAY * soft, seen_soft), (bias, to_bias, seen_bias)):
            past += grad * grad
            value -= rate * grad / np.sqrt(past)
    return Model(table @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


def fit(documents: DataFrame, labels: DataFrame, keep: Column | None = None, most_docs: int = 1200, label_col: str = "toxic") -> Model | None:
    """Train on a bounded sample of labelled documents; ``keep`` says which labels may be used."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy("doc_id").agg(F.max(label_col).alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    # a hash of the id under a share of its range takes about most_docs of each class
    part = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most_docs / n))])
    chosen = known.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 20)) < part[F.col("label")] * (1 << 20))
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batcher(pa.schema([("label", pa.int32()), ("words", pa.string()), ("codes", pa.binary())]))
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                known: dict[str, int] = {}
                codes = np.array([known.setdefault(w, len(known)) for w in tokens(text.as_py())], np.int32)
                if len(codes):
                    row = (label, " ".join(known), codes.tobytes())
                    yield from out.add(row, len(row[1]) + len(row[2]))
        yield out.flush()

    # chosen is bounded by most_docs for each class, whatever the size of the corpus; an id may stand in many rows
    drawn = texts.join(F.broadcast(chosen), "doc_id").select(F.col("label").cast("int"), "text", "doc_id")
    if drawn.select("doc_id").count() > (most := 8 * most_docs):
        drawn = drawn.limit(most)
    rows = drawn.orderBy("doc_id").select("label", "text").mapInArrow(coded, "label int, words string, codes binary").collect()
    y = np.array([r["label"] for r in rows], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return None
    return train([(r["words"].split(" "), np.frombuffer(r["codes"], np.int32)) for r in rows], y, prior=counts[1] / sum(counts.values()))


def scorer(model: Model | None):
    """A function that scores whole texts; words met before keep their margins."""
    kept: dict[str, float] = {}

    def score_of(text: str | None) -> tuple[float]:
        if model is None:
            return (0.0,)
        words = tokens(text)
        values = list(map(kept.get, words))
        for i in [i for i, v in enumerate(values) if v is None]:
            if len(kept) >= MOST_KEPT:
                kept.clear()
            values[i] = kept[words[i]] = model.word(words[i])
        return (float(1 / (1 + np.exp(-min(500.0, max(-500.0, model.window_margins(np.array(values)).max()))))),)

    return score_of


def with_scores(documents: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with all their columns, and a score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    return appended(documents, text_col, lambda: scorer(shared.value), f"`{score_col}` double")


def score(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score and predicted."""
    return with_scores(documents.select(id_col, text_col), model, text_col).selectExpr(f"`{id_col}`", "score", "cast(score >= 0.5 as int) as predicted")
