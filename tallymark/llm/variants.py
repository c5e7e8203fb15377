"""Groups of spelling variants: words one edit apart, found in a positional q-gram index.

A word of L characters, padded on both sides, has L + q - 1 positional q-grams. One edit
destroys at most q of them, all within q places, so of two grams that don't overlap one is
left, and a word's neighbours are all in the postings of those two: at the same place among
words of its length, at the same or the next place among words one longer. Each word asks for
the rarest such pair, by a chain of character trigrams counted over the vocabulary. Questions
and postings meet by gram in a sorted shuffle; the postings of a question are merged in order
of id, and a pair goes on if it shares as many positional grams as one edit leaves (the count
filter), then if it really is one edit. Grams of very many postings or questions are dealt
over a grid of cells, every question meeting every posting in one of them.

Defined results: a null text has no words and a null id counts as empty; repeated rows count
again; an empty table gives no words; columns that aren't asked for play no part. Of forms with
equal counts the first in code-point order is taken, and a form has at least twice its word's
count, so that following forms ends.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import lower_ascii, released, staged

#: Letters of a word: A to Z and the Latin-1 letters' block.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
Q = 5
LEAST_LENGTH, LEAST_COUNT = 5, 3
START, END = "\x01", "\x02"
#: Postings, or questions, of one gram that meet in a cell.
CELL = 20_000
#: Distinct words that a counting task holds before it hands them on; rows matched at once; characters compared at once.
MOST_WORDS, SLAB, BLOCK = 300_000, 150_000, 6_000_000


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[str], Callable[[str], str]] | None = None) -> DataFrame:
    """(word, n): runs of letters, A to Z in lower case, over all texts; ``change(id)(run)`` may alter a document's run."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Counter[str] = Counter()

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(have), pa.string()), pa.array(list(have.values()), pa.int64())], schema=schema)
            have.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Counter(RUN.findall(lower_ascii(text.as_py() or "")))
                if change is None:
                    have.update(own)
                else:
                    changed = change(key)
                    for w, n in own.items():
                        have[changed(w)] += n
                if len(have) >= MOST_WORDS:
                    yield give()
        yield give()
        del have, batches
        released()

    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def trigram_logs(vocab: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log frequencies of padded words' bigrams, and of trigrams given their bigram.

    At most the alphabet's cube of rows come to the driver: 92 characters, padding included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Counter[str] = Counter()
        for batch in batches:
            for w in batch.column(0).to_pylist():
                y = START * 2 + w + END * 2
                have.update([y[i : i + 3] for i in range(len(y) - 2)])
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.string()), pa.array(list(have.values()), pa.int64())], names=["gram", "n"])

    rows = vocab.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    pairs: Counter[str] = Counter()
    for r in rows:
        pairs[r["gram"][:2]] += r["n"]
    total = sum(pairs.values())
    return {p: log(n / total) for p, n in pairs.items()}, {r["gram"]: log(r["n"] / pairs[r["gram"][:2]]) for r in rows}


def places(length: int, asking: bool) -> range:
    """The grams that a word asks for, or is found by; those with one letter only where a word is too short for others."""
    skip = int(length >= 5 - asking)
    return range(skip, length + Q - 1 - skip)


def rarest(padded: str, length: int, pairs: dict[str, float], triples: dict[str, float]) -> tuple[int, int]:
    """The two grams that don't overlap and are least frequent by the chain of trigrams."""
    own = places(length, True)
    steps = [triples.get(padded[i : i + 3], 0.0) for i in range(len(padded) - 2)]
    cost = [exp(pairs.get(padded[j : j + 2], 0.0) + sum(steps[j : j + Q - 2])) for j in own]
    best, left = (float("inf"), 0, 0), 0
    for k in range(Q, len(cost)):
        left = min(left, k - Q, key=cost.__getitem__)
        best = min(best, (cost[left] + cost[k], left, k))
    return own[best[1]], own[best[2]]


_POSTINGS = "gram string, side int, pos int, id long, n long, word string"


def postings(vocab: DataFrame) -> DataFrame:
    """Every word's positional grams (side 1) and the two that it asks for (side 0)."""
    pairs, triples = trigram_logs(vocab)
    schema = pa.schema([("gram", pa.string()), ("side", pa.int32()), ("pos", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sides, at, of = [], [], [], []

        def give(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = pa.array(of, pa.int64())
            out = [pa.array(grams, pa.string()), pa.array(sides, pa.int32()), pa.array(at, pa.int32()), *(batch.column(i).take(own) for i in range(3))]
            for x in (grams, sides, at, of):
                x.clear()
            return pa.RecordBatch.from_arrays(out, schema=schema)

        for batch in batches:
            for i, w in enumerate(batch.column(2).to_pylist()):
                y = START * (Q - 1) + w + END * (Q - 1)
                found, asked = places(len(w), False), rarest(y, len(w), pairs, triples)
                grams += [y[j : j + Q] for j in (*found, *asked)]
                at += [*found, *asked]
                sides += [1] * len(found) + [0, 0]
                of += [i] * (len(found) + 2)
                if len(grams) >= 50_000:
                    yield give(batch)
            yield give(batch)

    return vocab.select("id", "n", "word").mapInArrow(run, _POSTINGS)


def dealt(rows: DataFrame, cell: int = CELL) -> DataFrame:
    """rows with ``cell``: of a gram with many postings or questions, each pair of the two meets in one cell.

    Hot grams are one in ``cell`` rows at most, which bounds what is broadcast.
    """
    sizes = rows.groupBy("gram").agg(F.sum("side").alias("found"), F.count("*").alias("every"))
    parts = lambda c: F.ceil(c / cell).cast("int")
    hot = sizes.select("gram", F.greatest(parts(F.col("found")), F.lit(1)).alias("across"), F.greatest(parts(F.col("every") - F.col("found")), F.lit(1)).alias("down"))
    joined = rows.join(F.broadcast(hot.where((F.col("across") > 1) | (F.col("down") > 1))), "gram", "left")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.when(F.col("side") == 1, F.transform(upto("down"), lambda d: d * F.col("across") + mine("across"))).otherwise(F.transform(upto("across"), lambda a: mine("down") * F.col("across") + a))
    return joined.select(*rows.columns, F.explode(F.when(F.col("across").isNull(), F.array(F.lit(0))).otherwise(own)).alias("cell"))


class _Words:
    """A slab's words as matrices of characters, one for each length."""

    def __init__(self, words: list[str], lengths: np.ndarray):
        self.row, self.matrix = np.zeros(len(words), np.int64), {}
        for n in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == n)
            self.row[of] = np.arange(len(of))
            self.matrix[n] = np.frombuffer("".join([words[i] for i in of.tolist()]).encode("utf-32-le"), "<u4").reshape(len(of), n)

    def padded(self, length: int, of: np.ndarray) -> np.ndarray:
        own = self.matrix[length][self.row[of]]
        return np.hstack([np.full((len(of), Q - 1), ord(START), np.uint32), own, np.full((len(of), Q - 1), ord(END), np.uint32)])


def _windows(same: np.ndarray) -> np.ndarray:
    """Where q neighbouring places are all the same."""
    out = same[:, : same.shape[1] - Q + 1].copy()
    for k in range(1, Q):
        out &= same[:, k : same.shape[1] - Q + 1 + k]
    return out


def one_edit(text: _Words, length: int, more: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs are one edit apart; words ``a`` have ``length`` characters, ``b`` as many or one more."""
    x, y = text.padded(length, a), text.padded(length + more, b)
    level = x == y[:, : x.shape[1]]
    shared = _windows(level)
    if more:
        later = x == y[:, 1:]
        shared |= _windows(later)
    out = shared.sum(1) >= length + more - 1  # L + q - 1 grams of the longer word, less the q that an edit takes
    keep = np.flatnonzero(out)
    if more:
        ahead = np.cumprod(level[keep, Q - 1 : Q - 1 + length], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
        behind = np.cumprod(later[keep, Q - 1 : Q - 1 + length][:, ::-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
        out[keep] = ahead + behind >= length
    else:
        out[keep] = (~level[keep]).sum(1) == 1
    return out


def _matched(run: np.ndarray, side: np.ndarray, pos: np.ndarray, ids: np.ndarray, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (question, posting) of a slab that are one edit apart, each once a gram."""
    lengths = np.array([len(w) for w in words], np.int64)
    asks, found = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(asks) or not len(found):
        return
    text, wide = _Words(words, lengths), int(pos.max()) + 2
    limits = np.unique(lengths[found] * wide + pos[found])  # the lists' lengths and places

    def lists(of: np.ndarray, more: int, later: int) -> np.ndarray:
        want = (lengths[of] + more) * wide + pos[of] + later
        k = np.minimum(np.searchsorted(limits, want), len(limits) - 1)
        return np.where(limits[k] == want, run[of] * len(limits) + k, -1)

    key = lists(found, 0, 0)
    order = np.lexsort((ids[found], key))
    found, key = found[order], key[order]
    for more, shifts in ((0, (0,)), (1, (0, 1))):
        spans = [(np.searchsorted(key, want := lists(asks, more, s), "left"), np.searchsorted(key, want, "right")) for s in shifts]
        many = sum(hi - lo for lo, hi in spans)
        own = lengths[asks]
        for n in np.unique(own[many > 0]).tolist():
            todo = np.flatnonzero((own == n) & (many > 0))
            block = np.cumsum(many[todo]) // max(1, BLOCK // (n + 2 * Q))
            for part in np.split(todo, np.flatnonzero(np.diff(block)) + 1):
                merged = []
                for lo, hi in spans:  # the lists' postings, each in order of id
                    size = (hi - lo)[part]
                    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[part], size)
                    merged.append(np.repeat(part, size) * len(found) + place if len(spans) == 1 else np.repeat(part, size) * len(ids) + found[place])
                if len(spans) == 1:
                    a, b = asks[merged[0] // len(found)], found[merged[0] % len(found)]
                    once = ids[a] < ids[b]  # of equally long words either finds the other
                    a, b = a[once], b[once]
                else:
                    codes = np.unique(np.concatenate(merged))  # a list may hold a word twice over, at either place
                    a, b = asks[codes // len(ids)], codes % len(ids)
                for i in range(0, len(a), max(1, BLOCK // (n + 2 * Q))):
                    p, m = a[i : i + max(1, BLOCK // (n + 2 * Q))], b[i : i + max(1, BLOCK // (n + 2 * Q))]
                    good = one_edit(text, n, more, p, m)
                    if good.any():
                        yield p[good], m[good]


_PAIRS = "word string, n long, other string, other_n long"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs one edit apart, from rows in order of gram, cell and side; questions of a gram stay until its rows end."""
    held: list[pa.RecordBatch] = []

    def matched(table: pa.Table) -> Iterator[pa.RecordBatch]:
        gram = table["gram"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        side, pos, ids, cell = (table[c].to_numpy() for c in ("side", "pos", "id", "cell"))
        run = np.cumsum(np.concatenate(([0], (np.diff(gram) != 0) | (np.diff(cell) != 0)))).astype(np.int64)
        word, n = table["word"].combine_chunks(), table["n"].combine_chunks()
        for a, b in _matched(run, side, pos, ids, word.to_pylist()):
            a, b = pa.array(a), pa.array(b)
            yield pa.RecordBatch.from_arrays([word.take(a), n.take(a), word.take(b), n.take(b)], names=["word", "n", "other", "other_n"])
        last = (run == run[-1]) & (side == 0)
        held[:] = table.filter(pa.array(last)).combine_chunks().to_batches()

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= SLAB:
            yield from matched(pa.Table.from_batches(held))
            size = 0
    if held:
        yield from matched(pa.Table.from_batches(held))
    del held, batches
    released()


def near_pairs(vocab: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, n, other, other_n): every pair of words one edit apart, once, from a stored table (word, n, id)."""
    rows = staged(postings(vocab), "variants-postings")
    met = dealt(rows, cell).repartition("gram", "cell").sortWithinPartitions("gram", "cell", "side")
    return met.mapInArrow(_merged, _PAIRS).distinct()


def variants(counts: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, cell: int = CELL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``counts`` that are long and frequent enough."""
    if least_length < 2:
        raise ValueError("words of one letter have no two grams apart")
    kept = counts.where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))
    vocab = staged(kept.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "variants-words")
    pairs = staged(near_pairs(vocab, cell), "variants-pairs")
    both = pairs.unionByName(pairs.selectExpr("other as word", "other_n as n", "word as other", "n as other_n"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    forms = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best")).alias("best"))
    forms = staged(forms.select("word", F.col("best.form").alias("form"), "n", "n_near", (-F.col("best.less")).alias("form_n")), "variants-forms")
    return forms.join(roots(forms.where("form IS NOT NULL").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that following forms reaches. Every round doubles the steps taken."""
    at = staged(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        onward = at.selectExpr("word as root", "root as onward")
        stepped = staged(at.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "variants-roots")
        at = stepped.select("word", "root")
        if not stepped.where("moved").limit(1).count():
            return at
