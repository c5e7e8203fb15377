"""Katz backoff over words: discounted n-grams that fall back to the next shorter ones.

Counts are gathered from all training documents. Counts up to ``FEW`` are discounted by
Good-Turing, order by order; what a context loses goes to the words never seen after it, shared out
by the next shorter model with a weight that makes the context sum to one exactly. At the end of
the recursion, what single words lose is the probability of the one unknown word.

  P(w)     = d(c(w)) / N                      for known w; the rest is the unknown word's
  P(w | h) = d(c(h w)) / (c(h) + HELD)        if h w was seen
           = a(h) P(w | h')                   if h was seen, but never with w
           = P(w | h')                        if h was never seen
  a(h)     = (1 - sum of P(v | h) over seen v) / (1 - sum of P(v | h') over seen v)

h' is h without its first word. ``HELD`` keeps a(h) positive where every count is too large to
be discounted: it makes the denominator of seen words larger than Katz's own by a tenth of a word.

The corpus stays in chunks. A chunk asks for the counts of its distinct n-grams of every order; a
key range adds them up, answers, and keeps them as a row of the stored n-gram table (``counts``:
order, key range, keys, counts). It names one chunk that owns each n-gram, so that the sums
of a(h) meet every seen n-gram once: chunks send, for each context, how many of its n-grams have which
count, whole numbers all; a key range adds them up, keeps the weights as a row of the stored
table (``weights``) and gives back log a(h) to the chunks that need it. Then each chunk evaluates
its tokens from the longest order down.

A question is one row for each chunk and key range; ranges hold about ``RANGE`` asked keys, so
that memory is bounded and rows are few: chunks times ranges, each of some hundred keys and more up
to some tens of GB of text. Beyond, larger chunks keep rows long.

Defined results: a null text is empty and is scored as the end alone; documents are numbered
by row, so repeated ids and null ids keep rows of their own; words longer than any limit are
whole words; other columns are left out, whatever their names; without training documents c, N
and V are 0, base is log10(0.1 / 0.1) for each token and score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm import chunks as C
from tallymark.llm.common import released, staged

FEW, HELD = 5, 0.1
#: Text in a chunk; a task holds about thirty times as much while it scores one.
CHUNK_BYTES = 6 << 20
#: Keys that a range is meant to be asked for, and keys of an order that a chunk is taken to ask for.
RANGE, ASKED = 1 << 20, {1: 60_000, 2: 500_000}
#: Keys of the end of a text and of the place before its first word.
END, BEGIN = np.uint64(0x3C2F733E3C2F733E), np.uint64(0x3C733E3C733E3C73)
_TURN = np.uint64(0x9E3779B97F4A7C15)


def good_turing(counts_of_counts: np.ndarray) -> np.ndarray:
    """Discounted values of the counts 0 to FEW; ``counts_of_counts[r]``: entries seen r times.

    Where the estimate isn't between 0 and r (few or odd data), half a count is taken off.
    """
    n = counts_of_counts.astype(float)
    values = np.arange(FEW + 1, dtype=float)
    past = (FEW + 1) * n[FEW + 1] / n[1] if n[1] else 1.0
    for r in range(1, FEW + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - past) / (1 - past) if n[r] and past != 1 else 0.0
        values[r] = r * d if 0 < d < 1 else r - 0.5
    return values


@dataclass
class Statistics:
    """What all tasks need to know: a few dozen numbers, however large the corpus."""

    total: int
    distinct: int
    documents: int
    #: Discounted values of small counts, by order.
    discounts: dict[int, np.ndarray]
    scale: float
    unknown: float

    @classmethod
    def of(cls, several: dict[int, np.ndarray], total: int, distinct: int, documents: int) -> Statistics:
        """``several[m]``: how many n-grams of order m were seen r times."""
        values = {m: good_turing(n) for m, n in several.items()}
        kept = total - sum((r - values[1][r]) * several[1][r] for r in range(1, FEW + 1))
        scale = 1.0 if kept < total or not total else total / (total + 1)  # some room for the unknown word
        return cls(total, distinct, documents, values, scale, 1 - scale * kept / total if total else 1.0)

    def discounted(self, order: int, c: np.ndarray) -> np.ndarray:
        return np.where(c > FEW, c, self.discounts[order][np.minimum(c, FEW)])

    def lost(self, order: int) -> np.ndarray:
        """What an n-gram seen 1 to FEW times loses."""
        return np.arange(1, FEW + 1) - self.discounts[order][1:]

    def word(self, c: np.ndarray) -> np.ndarray:
        """P(w) by the word's count."""
        return np.where(c > 0, self.scale * self.discounted(1, c) / max(1, self.total), self.unknown)


class Chunk:
    """A chunk's tokens: words and an end for each document, and their n-grams up to an order."""

    def __init__(self, row, order: int):
        self.ids, self.known, self.train, self.lengths = C.documents(row)
        codes, hashes = C.codes_of(row), C.word_hashes(row.vocab)
        self.sizes = self.lengths + 1
        ends = np.cumsum(self.sizes) - 1
        n = int(self.sizes.sum())
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        word = np.full(n, len(hashes), np.int32)
        inside = np.ones(n, bool)
        inside[ends] = False
        word[inside] = codes
        self.first = np.concatenate(([0], ends[:-1] + 1)) if n else np.zeros(0, np.int64)
        self.in_training = self.train[self.doc].astype(bool)
        table = np.concatenate((hashes, [END])).astype(np.uint64)
        key, begin = table[word], BEGIN
        #: Distinct keys of each order, each token's place among them, and the key of a context of only beginnings.
        self.keys: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}
        self.begin: dict[int, np.uint64] = {}
        whole = key
        for m in range(1, order + 1):
            if m > 1:  # the context is the n-gram that ends at the token before
                before = np.empty(n, np.uint64)
                before[1:] = whole[:-1]
                before[self.first] = begin
                self.begin[m - 1] = begin
                whole = C.mixed(before * _TURN + key)
                begin = C.mixed(np.array([begin], np.uint64) * _TURN + BEGIN)[0]
            self.keys[m], place = np.unique(whole, return_inverse=True)
            self.place[m] = place.astype(np.int32)

    def counted(self, m: int) -> np.ndarray:
        return np.bincount(self.place[m][self.in_training], minlength=len(self.keys[m])).astype(np.uint32)

    def context(self, m: int) -> np.ndarray:
        """Each token's context of m words, as a place among the keys of order m; -1: only beginnings."""
        out = np.empty(len(self.doc), np.int32)
        out[1:] = self.place[m][:-1]
        out[self.first] = -1
        return out

    def one_of_each(self, m: int) -> np.ndarray:
        """A token for each distinct n-gram."""
        first = np.empty(len(self.keys[m]), np.int64)
        first[self.place[m][::-1]] = np.arange(len(self.doc))[::-1]
        return first


def _ask(order: int, ranges: dict[int, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                c = Chunk(row, order)
                for m in c.keys:
                    yield C.asked(m, row.chunk, c.keys[m], [c.counted(m)], ranges[m])
        released()

    return run


def _count(frame: pd.DataFrame) -> pd.DataFrame:
    """A range's counts: an answer for each chunk, and the range's row of the n-gram table."""
    distinct, place, spans = C.merge(frame)
    asked = np.concatenate([C.from_planes(d[0], "<u4") for d in frame["data"]])
    total = np.bincount(place, asked, len(distinct)).astype(np.int64)
    held = np.flatnonzero(asked)
    owner = np.full(len(distinct), -1)
    owner[place[held][::-1]] = held[::-1]  # the first asker that has it in training
    own = np.zeros(len(place), np.uint8)
    own[owner[owner >= 0]] = 1
    seen = total > 0
    several = np.bincount(np.minimum(total[seen], FEW + 2), minlength=FEW + 3)
    out = pd.DataFrame({"kind": frame["kind"], "bucket": frame["bucket"], "chunk": frame["chunk"], "answer": [C.planes(total[place[s]].astype("<u4")) + np.packbits(own[s]).tobytes() for s in spans]})
    out["stats"], out["keys"], out["counts"] = None, None, None
    table = {"kind": -frame["kind"].iloc[0], "bucket": frame["bucket"].iloc[0], "chunk": -1, "answer": None, "stats": [int(x) for x in (total.sum(), seen.sum(), *several)], "keys": C.pack_keys(distinct[seen]), "counts": C.planes(total[seen].astype("<u4"))}
    return pd.concat((out, pd.DataFrame([table])), ignore_index=True)


def counts_of(answers, kind: int, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and ownership of a chunk's keys of one kind; ``sizes``: keys asked of each range."""
    parts = [bytes(a["answer"]) for a in (answers if answers is not None else ()) if a["kind"] == kind]
    sizes = [n for n in sizes if n]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    counts = np.concatenate([C.from_planes(p[: 4 * n], "<u4") for p, n in zip(parts, sizes, strict=True)]).astype(np.int64)
    return counts, np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8, offset=4 * n), count=n) for p, n in zip(parts, sizes, strict=True)]).astype(bool)


class _Known:
    """A chunk's tokens with their counts: for every order, of the n-gram and of its context."""

    def __init__(self, row, order: int, ranges: dict[int, int], stats: Statistics):
        self.chunk = c = Chunk(row, order)
        self.counts, self.owned, self.heads = {}, {}, {}
        for m in range(1, order + 1):
            self.counts[m], self.owned[m] = counts_of(row.answers, m, np.diff(C.bounds(c.keys[m], ranges[m])).tolist())
        for m in range(1, order):
            before = c.context(m)
            self.heads[m] = np.where(before < 0, stats.documents, self.counts[m][before])

    def wanted(self, m: int) -> np.ndarray:
        """Tokens that fall back from a context of m words."""
        c = self.chunk
        return np.flatnonzero((self.counts[m + 1][c.place[m + 1]] == 0) & (self.heads[m] > 0))


def _contexts(order: int, ranges: dict[int, int], stats: Statistics):
    """Rows (kind: order of the context, bucket, chunk, keys, data): what a chunk knows of the
    n-grams it owns, and which weights it wants; and one row of kind 0 with its documents' sums
    without weights, and the places where the wanted weights belong."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                k = _Known(row, order, ranges, stats)
                c = k.chunk
                words = k.counts[1][c.place[1]]
                base = np.log10((words + 0.1) / (stats.total + 0.1 * (stats.distinct + 1)))
                logs = np.log10(stats.word(words))  # of the shortest order; longer ones take its place where they know more
                belongs = []
                for m in range(1, order):
                    count = k.counts[m + 1][c.place[m + 1]]
                    logs = np.where(count > 0, np.log10(stats.discounted(m + 1, np.maximum(count, 1))) - np.log10(k.heads[m] + HELD), logs)
                    mine, wanting = c.one_of_each(m + 1)[k.owned[m + 1]], k.wanted(m)
                    before, none = c.context(m), len(c.keys[m])
                    before = np.where(before < 0, none, before)  # the context of only beginnings comes last
                    at, whole, short = before[mine], k.counts[m + 1][k.owned[m + 1]], k.counts[m][c.place[m][mine]]
                    long = [np.bincount(at[whole == r], minlength=none + 1) for r in range(1, FEW + 1)]
                    less = [np.bincount(at[short == r], minlength=none + 1) for r in range(1, FEW + 1)]
                    low_sum = np.bincount(at, short, none + 1)
                    wanted = np.zeros(none + 1, bool)
                    wanted[before[wanting]] = True
                    used = wanted.copy()
                    used[at] = True
                    head, low_head = np.zeros(none + 1, np.int64), np.zeros(none + 1, np.int64)
                    for tokens in (mine, wanting):
                        head[before[tokens]] = k.heads[m][tokens]
                        if m > 1:
                            low_head[before[tokens]] = k.heads[m - 1][tokens]
                    keys = np.concatenate((c.keys[m], [c.begin[m]])).astype(np.uint64)
                    chosen = np.flatnonzero(used)
                    chosen = chosen[np.argsort(keys[chosen])]
                    columns = [*(x.astype("<u4") for x in (*long, *less)), low_sum.astype("<u8"), head.astype("<u8"), low_head.astype("<u8"), wanted.astype(np.uint8)]
                    yield C.asked(m, row.chunk, keys[chosen], [x[chosen] for x in columns], ranges[m])
                    number = np.zeros(none + 1, np.int32)  # of a context among the answers that come
                    own = chosen[wanted[chosen]]
                    number[own] = np.arange(len(own))
                    belongs += [number[before[wanting]].astype("<i4"), c.doc[wanting].astype("<i4")]
                sums = [np.bincount(c.doc, x, len(c.sizes)) for x in (words > 0, base, logs)]
                data = [c.ids, c.known.astype(np.uint8), c.train, c.sizes, sums[0].astype("<i8"), sums[1], sums[2], *belongs]
                yield pd.DataFrame({"kind": [0], "bucket": [row.chunk % ranges[1]], "chunk": [row.chunk], "keys": [b""], "data": [[np.ascontiguousarray(x).tobytes() for x in data]]})
        released()

    return run


def _weigh(stats: Statistics):
    kinds = ["<u4"] * (2 * FEW) + ["<u8"] * 3 + ["u1"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        m = int(frame["kind"].iloc[0])
        if not m:
            return frame.assign(answer=None, keys=None, weights=None, parts=frame["data"])[["kind", "bucket", "chunk", "answer", "keys", "weights", "parts"]]
        distinct, place, spans = C.merge(frame)
        columns = [np.concatenate([C.from_planes(d[i], kind) for d in frame["data"]]) for i, kind in enumerate(kinds)]
        sums = [np.bincount(place, x, len(distinct)) for x in columns[: 2 * FEW + 1]]
        head, low_head = np.zeros(len(distinct)), np.zeros(len(distinct))
        head[place], low_head[place] = columns[2 * FEW + 1], columns[2 * FEW + 2]
        seen = head - sum(n * x for n, x in zip(sums[:FEW], stats.lost(m + 1), strict=True))
        low = sums[2 * FEW] - sum(n * x for n, x in zip(sums[FEW : 2 * FEW], stats.lost(m), strict=True))
        low = low / (low_head + HELD) if m > 1 else low * stats.scale / max(1, stats.total)
        weight = np.log10((1 - seen / (head + HELD)) / (1 - low))
        wanted = columns[-1].astype(bool)
        out = pd.DataFrame({"kind": m, "bucket": frame["bucket"], "chunk": frame["chunk"], "answer": [C.planes(weight[place[s]][wanted[s]]) for s in spans]})
        out["keys"], out["weights"], out["parts"] = None, None, None
        table = {"kind": -m, "bucket": frame["bucket"].iloc[0], "chunk": -1, "answer": None, "keys": C.pack_keys(distinct), "weights": C.planes(weight.astype("<f4")), "parts": None}
        return pd.concat((out, pd.DataFrame([table])), ignore_index=True)

    return run


_SCORE_DDL = "doc_id long, in_training int, n_tokens long, n_known long, base_score double, score double"


def _score(order: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = ("<i8", np.uint8, np.uint8, "<i8", "<i8", "<f8", "<f8", *["<i4"] * (2 * (order - 1)))
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids, known, train, sizes, n_known, base, score, *belongs = (np.frombuffer(x, k) for x, k in zip(row.parts, kinds, strict=True))
                for m in range(1, order):
                    number, doc = belongs[2 * m - 2 : 2 * m]
                    score = score + np.bincount(doc, C.answer_of(row.answers, m, "<f8")[number], len(ids))
                yield pd.DataFrame({"doc_id": C.id_column(ids, known.astype(bool)), "in_training": train.astype(np.int32), "n_tokens": sizes, "n_known": n_known, "base_score": base, "score": score})

    return run


class Model:
    """A trained model: the corpus in chunks, the stored tables of counts and weights, their statistics.

    ``counts`` holds the n-gram table by order (-kind) and key range, ``weights`` log a(h) by order of
    the context and key range; beside them stand the answers to the chunks.
    """

    def __init__(self, docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = 2):
        """``train`` says which rows are learnt from (all, if not given); all rows can be scored."""
        if order < 2:
            raise ValueError("the order has to be at least 2")
        self.id_col, self.order = id_col, order
        self.chunks = staged(C.encode(docs, lower=True, flag=F.lit(1) if train is None else train, id_col=id_col, text_col=text_col, chunk_bytes=CHUNK_BYTES), "token-chunks")
        n = self.chunks.select("chunk").count()
        self.ranges = {m: max(12, -(-n * ASKED.get(m, 1_000_000) // RANGE)) for m in range(1, order + 1)}
        found = C.answered(self.chunks.mapInPandas(_ask(order, self.ranges), C.ASKED_DDL), _count, C.ANSWER_DDL + ", stats array<long>, keys binary, counts binary")
        self.counts = staged(found, "ngram-counts")
        sums = {m: np.zeros(FEW + 5, np.int64) for m in range(1, order + 1)}
        long = self.counts.where("kind < 0").select("kind", F.posexplode("stats").alias("i", "n")).groupBy("kind", "i").agg(F.sum("n").alias("n"))
        for r in long.collect():  # a few numbers for each order
            sums[-r["kind"]][r["i"]] = r["n"]
        documents = self.chunks.select("flags").mapInPandas(_training_documents, "n long").agg(F.sum("n")).first()[0] or 0
        self.statistics = Statistics.of({m: s[2:] for m, s in sums.items()}, int(sums[1][0]), int(sums[1][1]), int(documents))
        known = C.with_answers(self.chunks, self.counts.where("kind > 0").select("chunk", "kind", "bucket", "answer"))
        asked = known.mapInPandas(_contexts(order, self.ranges, self.statistics), C.ASKED_DDL)
        self.weights = staged(C.answered(asked, _weigh(self.statistics), C.ANSWER_DDL + ", keys binary, weights binary, parts array<binary>"), "backoff-weights")

    def score(self) -> DataFrame:
        """Per row: id, in_training, n_tokens, n_known, train_tokens, base_score, score."""
        parts = self.weights.where("kind = 0").select("chunk", "parts")
        scored = C.with_answers(parts, self.weights.where("kind > 0").select("chunk", "kind", "bucket", "answer")).mapInPandas(_score(self.order), _SCORE_DDL)
        return scored.select(F.col("doc_id").alias(self.id_col), "in_training", "n_tokens", "n_known", F.lit(self.statistics.total).cast("long").alias("train_tokens"), "base_score", "score")


def _training_documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"n": [int(np.frombuffer(f, np.uint8).sum()) for f in frame["flags"]]})
