"""Exact substring deduplication over words: seed and extend.

Seeds are winnowed anchors: of the hashes of all ``SEED`` consecutive words, the smallest in
every window of ``span`` words (the last of equal ones). Equal windows have the same anchor at
the same place, so every repeated window holds an anchor that stands elsewhere too. All places
of an anchor meet its leader, the earliest place, by a join on the anchor. Anchors on one
diagonal of two documents chain to a stretch; the leader's words of that stretch are fetched and
the match is extended both ways, word by word. Matches of ``span`` words and more are kept as
maximal repeats of what stands earlier, and their words are removed.

A window may differ from its leader and still equal another place of the anchor. Such windows
were in a stretch and weren't matched; they meet again under the hash of all their words, with the
earliest of them as leader, and are extended in the same way. If a leader of equal hash turns
out to have other words, these windows go on with another hash, until none is left: hashes
propose, words decide.

Places meet only their leader, so a passage in a third of all rows costs a row for each of its
places; stretches asked of one document are dealt into groups of about ``ASKED``. Texts lie
bucketed by row, so that joins with them move no text.

Defined results: null, empty and short texts have no window and lose nothing; the order is
(doc_id, start), a null id before all others; rows that repeat a doc_id are places of the same
document, so an exact repetition of a row leaves both as they are; other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tallymark.llm.chunks import mixed
from tallymark.llm.common import Batcher, dropped, released, shared_path, staged, words

SPAN, SEED = 20, 8
#: Words that are hashed together, words whose hashes a task keeps, stretches asked of one copy of a text.
BLOCK, MOST_KEPT, ASKED = 1 << 18, 200_000, 500
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    ups = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _STEP))), dtype=np.uint64)
    downs = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, inverse))), dtype=np.uint64)
    return ups, downs


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    ups, downs = _powers(len(hashes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * ups[:-1], dtype=np.uint64)))
    starts = np.arange(len(hashes) - n + 1)
    return mixed((sums[starts + n] - sums[starts]) * downs[starts])


class Hasher:
    """Hashes of words and of runs of words, cut to ``bits``; words met before keep theirs."""

    def __init__(self, seed: int, bits: int = 64):
        self.seed, self.shift, self.kept = seed, np.uint64(64 - bits), {}

    def words(self, own: list[str]) -> np.ndarray:
        out = list(map(self.kept.get, own))
        for i in [i for i, h in enumerate(out) if h is None]:
            if len(self.kept) >= MOST_KEPT:
                self.kept.clear()
            out[i] = self.kept[own[i]] = xxhash.xxh3_64_intdigest(own[i], self.seed)
        return np.array(out, np.uint64)

    def runs(self, own: list[str], n: int) -> np.ndarray:
        return rolling(self.words(own), n) >> self.shift


def winnowed(seeds: np.ndarray, wide: int) -> np.ndarray:
    """Place of the smallest seed of every ``wide`` neighbours, the last of equal ones."""
    n = max(len(seeds) - wide + 1, 0)
    best, place = seeds[wide - 1 :], np.full(n, wide - 1)
    for k in range(wide - 2, -1, -1):  # from the right, so the last of equal ones stays
        now = seeds[k : k + n]
        less = now < best
        best, place = np.where(less, now, best), np.where(less, k, place)
    return place + np.arange(n)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _places(own: DataFrame, span: int, bits: int) -> DataFrame:
    """(key, id, row, start) of every anchor."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(0, bits)
        for batch in batches:
            held: list[str] = []  # words of many documents, one after the other
            rows: list[int] = []
            sizes: list[int] = []

            def give(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                ends = np.cumsum(sizes)
                seeds = hasher.runs(held, SEED)
                whole = np.ones(len(held) - span + 1, bool)  # windows of one document
                for k in range(1, span):
                    whole[ends[:-1] - k] = False
                places = winnowed(seeds, span - SEED + 1)[whole]
                places = places[np.concatenate(([True], places[1:] != places[:-1]))]  # ascending
                of = np.searchsorted(ends, places, "right")
                take = pa.array(np.array(rows)[of])
                starts = places - (ends - sizes)[of]
                held.clear(), rows.clear(), sizes.clear()
                return pa.RecordBatch.from_arrays([_signed(seeds[places]), batch.column(1).take(take), batch.column(0).take(take), pa.array(starts.astype(np.int32))], schema=schema)

            for i, text in enumerate(batch.column(2)):
                mine = words(text.as_py())
                if len(mine) >= span:
                    held += mine
                    rows.append(i)
                    sizes.append(len(mine))
                    if len(held) >= BLOCK:
                        yield give()
            if held:
                yield give()
        released()

    return staged(own.select("row", "id", "text").mapInArrow(run, "key long, id long, row long, start int"), "anchors")


def _stretches(places: DataFrame, before: int, after: int, by_row: bool = False) -> DataFrame:
    """(row, at, n, row0, at0): stretches of words that may equal earlier ones.

    Each place that isn't its key's earliest gives ``before`` words before and ``after`` from it on;
    those that touch on one diagonal of two rows are one stretch. ``at0`` may lie outside. Rows of one id are one
    document, or with ``by_row`` each a document of its own, in order of row.
    """
    order = ("id", "row", "start") if by_row else ("id", "start", "row")
    first = places.groupBy("key").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n")).where("n > 1")
    leaders = staged(first.selectExpr("key", "first.id as id0", "first.start as start0", "first.row as row0"), "leaders")
    own = F.col("row") == F.col("row0") if by_row else F.col("id").eqNullSafe(F.col("id0"))
    later = ~(own & (F.col("start") == F.col("start0")))
    hits = places.join(leaders, "key").where(later).select("row", "row0", (F.col("start") - F.col("start0")).alias("shift"), "start")
    lines = hits.groupBy("row", "row0", "shift").agg(F.sort_array(F.collect_list("start")).alias("starts"))  # at most the places of one row
    schema = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("row0", pa.int64()), ("at0", pa.int32())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(3)
            values = starts.flatten().to_numpy()
            if not len(values):
                continue
            sizes = np.diff(starts.offsets.to_numpy())
            line = np.repeat(np.arange(len(sizes)), sizes)
            new = np.ones(len(values), bool)
            new[1:] = (line[1:] != line[:-1]) | (values[1:] - values[:-1] > before + after)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(values)) - 1
            of = pa.array(line[head])
            at = np.maximum(values[head] - before, 0)
            shift = batch.column(2).take(of).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(at.astype(np.int32)), pa.array((values[tail] + after - at).astype(np.int32)), batch.column(1).take(of), pa.array((at - shift).astype(np.int32))], schema=schema)

    out = staged(lines.mapInArrow(chain, "row long, at int, n int, row0 long, at0 int"), "stretches")
    dropped(leaders)
    return out


def _fetched(own: DataFrame, stretches: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """(row, at, words): the earlier words of each stretch, joined by spaces; empty where there are none.

    ``held`` gets the tables that the result reads.
    """
    copies = F.ceil(F.col("n") / ASKED).cast("int")
    sizes = staged(stretches.groupBy("row0").agg(F.count("*").alias("n")).select("row0", copies.alias("copies")), "asked")
    # stored, so that a leader asked by many rows is split in this join and dealt by copy after it
    asked = staged(stretches.join(sizes, "row0").withColumn("copy", F.pmod(F.xxhash64("row", "at"), F.col("copies")).cast("int")).drop("copies"), "questions")
    if held is not None:
        held += [sizes, asked]
    asked = asked.groupBy("row0", "copy").agg(F.collect_list(F.struct("row", "at", "n", "at0")).alias("asked"))  # about ASKED
    texts = own.join(sizes, own["row"] == sizes["row0"]).select("row0", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "text").repartition("row0", "copy")
    schema = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batcher(schema)
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                mine = words(text.as_py())
                for x in wanted.as_py():
                    low, high = x["at0"], x["at0"] + x["n"]
                    part = mine[max(low, 0) : max(high, 0)]
                    if low < 0 or high > len(mine):  # the earlier text begins or ends inside
                        part = [""] * min(x["n"], max(-low, 0)) + part
                        part += [""] * (x["n"] - len(part))
                    found = " ".join(part)
                    yield from out.add((x["row"], x["at"], found), 48 + len(found))
        yield out.flush()
        released()

    return asked.join(texts, ["row0", "copy"]).select("text", "asked").mapInArrow(run, "row long, at int, words string")


def _runs(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of true values of at least ``least``."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= least]


def _extended(own: DataFrame, fetched: DataFrame, span: int, seed: int, bits: int) -> DataFrame:
    """(row, id, spans, open, keys) of each row with stretches: matches of ``span`` words and more,
    windows that weren't matched, and these windows' hashes under another seed."""
    per_row = fetched.groupBy("row").agg(F.collect_list(F.struct("at", "words")).alias("found"))  # bounded by the row's own text
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("spans", pa.binary()), ("open", pa.binary()), ("keys", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, hasher = Batcher(schema), Hasher(seed, bits)
        for batch in batches:
            for row, key, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                mine = words(text.as_py())
                n = max(len(mine) - span + 1, 0)
                met, matched, spans = np.zeros(n, bool), np.zeros(n, bool), []
                for x in found.as_py():
                    at, theirs = x["at"], x["words"].split(" ")
                    ours = mine[at : at + len(theirs)]
                    met[at : at + len(ours) - span + 1] = True
                    if ours == theirs:
                        runs = [(0, len(ours))] if len(ours) >= span else []
                    else:
                        runs = _runs(np.array([a == b for a, b in zip(ours, theirs)], bool), span)
                    for a, b in runs:
                        spans.append((at + a, at + b))
                        matched[at + a : at + b - span + 1] = True
                left = np.flatnonzero(met & ~matched)
                keys = hasher.runs(mine, span)[left] if len(left) else np.zeros(0, np.uint64)
                packed = np.array(sorted(set(spans)), "<i4").tobytes(), left.astype("<i4").tobytes(), keys.astype("<u8").tobytes()
                yield from out.add((row, key, *packed), 64 + sum(map(len, packed)))
        yield out.flush()
        released()

    return staged(own.join(per_row, "row").select("row", "id", "text", "found").mapInArrow(run, "row long, id long, spans binary, open binary, keys binary"), "matches")


def _open(matches: DataFrame) -> DataFrame:
    """(key, id, row, start) of windows that weren't matched."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, keys = ([np.frombuffer(x.as_py(), kind) for x in batch.column(i)] for i, kind in ((2, "<i4"), (3, "<u8")))
            if starts:
                take = pa.array(np.repeat(np.arange(len(starts)), [len(s) for s in starts]))
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), batch.column(1).take(take), batch.column(0).take(take), pa.array(np.concatenate(starts))], schema=schema)

    return matches.where("length(open) > 0").select("row", "id", "open", "keys").mapInArrow(run, "key long, id long, row long, start int")


def _bucketed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(row, id, text) in as many buckets by row as there are shuffle partitions: a stored table."""
    spark = docs.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"texts_{uuid.uuid4().hex}"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *more)
    rows.repartition(n, "row").write.bucketBy(n, "row").option("compression", "zstd").option("path", shared_path(spark, "texts")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; only the name goes
    return table


def _marked(own: DataFrame, span: int, hash_bits: int, by_row: bool = False) -> DataFrame:
    """own with ``spans``, the words to remove of each row."""
    if span < SEED:
        raise ValueError(f"the span has to be at least {SEED} words")
    anchors = _places(own, span, hash_bits)
    stretches = _stretches(anchors, span - SEED, span, by_row)
    dropped(anchors)

    def matched(seed: int) -> DataFrame:
        held = [stretches]
        out = _extended(own, _fetched(own, stretches, held), span, seed, hash_bits)
        dropped(*held)
        return out

    matches = matched(1)
    every, seed = matches.select("row", "spans"), 2
    while True:  # windows that equal a place other than their anchor's leader; again only after a collision
        stretches = _stretches(_open(matches), 0, span, by_row)
        if not stretches.limit(1).count():
            break
        matches = matched(seed)
        every, seed = every.unionByName(matches.select("row", "spans")), seed + 1
    marks = every.where("length(spans) > 0").groupBy("row").agg(F.collect_list("spans").alias("spans"))  # one for each round
    return own.join(marks, "row", "left")


def _kept(mine: list[str], spans: list[bytes] | None) -> list[str]:
    if not spans:
        return mine
    gone = np.zeros(len(mine), bool)
    for a, b in np.concatenate([np.frombuffer(s, "<i4") for s in spans]).reshape(-1, 2).tolist():
        gone[a:b] = True
    return [w for w, g in zip(mine, gone.tolist(), strict=True) if not g]


def without_repeats(docs: DataFrame, changed_col: str, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with all columns, without the passages that ``dedup_substrings`` removes, and whether a text has changed.

    Rows that share an id, null ids too, are each a document of their own. A text that loses nothing stays as it is, white space included; one that does is its words joined by spaces.
    Rows go through one stored table and aren't shuffled again.
    """
    rest = [c for c in docs.columns if c != text_col]
    own = _marked(_bucketed(docs, id_col, text_col, F.struct(*rest).alias("rest")), span, 64, by_row=True).select("rest", "text", "spans")
    out = StructType([own.schema["rest"], own.schema["text"], StructField("changed", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                texts.append(" ".join(_kept(words(text), spans)) if spans else text)
                changed.append(bool(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(changed, pa.bool_())], names=["rest", "text", "changed"])
        released()

    new = own.mapInArrow(run, out)
    return new.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns], F.col("changed").alias(changed_col))


def dedup_substrings(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hash_bits: int = 64) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    ``hash_bits`` is the width of the hashes that propose matches; it changes no result.
    """
    own = _marked(_bucketed(docs, id_col, text_col), span, hash_bits)
    fields = [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        fields, ddl = [*fields, ("kept_text", pa.string())], ddl + ", kept_text string"
    schema = pa.schema(fields)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batcher(schema)
        for batch in batches:
            for key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                mine = words(text.as_py())
                kept = _kept(mine, spans)
                joined = " ".join(kept)
                row = (key, len(mine), len(mine) - len(kept), hashlib.sha256(joined.encode()).hexdigest())
                yield from out.add(row + (joined,) * with_text, 128 + len(joined) * with_text)
        yield out.flush()
        released()

    done = own.select("id", "text", "spans").mapInArrow(remove, ddl)
    return done.withColumnRenamed("id", id_col)
