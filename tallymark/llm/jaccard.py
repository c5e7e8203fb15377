"""Similarity self-join of documents by the Jaccard similarity of their word n-grams.

A size-aware join of light and heavy sets. Two sets with a similarity of at least t share all
but a known number of the elements of each, so under one global order their first elements
hold common ones. Small (light) sets enumerate all subsets of size ``SUBSET`` of their first
elements; large (heavy) sets are met on the inverted lists of their first elements. The
boundary is the size at which the subsets cost more than scanning the lists, by counts over
the whole corpus; sets near it do both. The order puts rare elements first, by a table of
counters over all documents whose size is fixed.

Equal sets are one class from the start. In the lists, each member first meets the list's
leader; what these pairs connect needs no further pair. Only lists whose members are still in
different components are scanned for pairs across components, in blocks, where a bound from
histograms (128 counts for each set) rejects nearly all others before sets are fetched. Every
pair that is kept was verified on whole sets, and no pair of linked sets in different
components is left out.

Defined results: null texts and texts without words have empty sets, link with nothing and are
their own component; a null id never names a component of others, and a component whose ids
are all null has a null component_id; rows that repeat an id are documents of their own;
repeated rows are in one class. Elements are 64-bit hashes, classes 64-bit hashes of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm import chunks as C
from tallymark.llm.common import Batcher, dropped, handing_back, is_staged, lower_ascii, staged, words
from tallymark.llm.components import components

SUBSET = 2
COUNTERS, SLICES = 1 << 21, 64
HISTOGRAM = 128
#: Members of a list that are compared in one group, and rows up to which a side is broadcast.
BLOCK, SMALL = 4096, 200_000
#: Members up to which a list is joined with itself.
SHORT = 16
MOST_KEPT = 300_000
#: Classes whose signatures are made at a time: a class may have hundreds.
SLICE = 500
_TURN = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sets of hashed word n-grams; words met before keep their hashes."""

    def __init__(self, n: int):
        self.n, self.kept = n, {}

    def set_of(self, text: str | None) -> np.ndarray:
        """The ascending distinct hashes; with fewer than n words, of the whole sequence."""
        own = words(lower_ascii(text)) if text else []
        if not own:
            return np.zeros(0, np.uint64)
        out = list(map(self.kept.get, own))
        for i in [i for i, h in enumerate(out) if h is None]:
            if len(self.kept) >= MOST_KEPT:
                self.kept.clear()
            out[i] = self.kept[own[i]] = xxhash.xxh3_64_intdigest(own[i])
        h = np.array(out, np.uint64)
        n = min(self.n, len(h))
        key = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            key = C.mixed(key * _TURN + h[k : len(h) - n + 1 + k])
        if n < self.n:
            key = C.mixed(key + np.uint64(n))
        key.sort()
        return key[np.concatenate(([True], key[1:] != key[:-1]))]


def least_overlap(n: int, t100: int) -> int:
    """Elements of a set of size n that any partner has."""
    return -(-n * t100 // 100)


def prefix_length(n: int, t100: int) -> int:
    return n - least_overlap(n, t100)


def bound(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, t100: int) -> np.ndarray:
    """Whether two sets can be similar enough, by their histograms: they differ in at least
    as many elements as the histograms do."""
    total, apart = na + nb, np.abs(a.astype(np.int32) - b).sum(-1)
    return 100 * (total - apart) >= t100 * (total + apart)


def counters(docs: DataFrame, n: int) -> np.ndarray:
    """How many (document, element) pairs fall on each counter; a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, table = Shingler(n), np.zeros(COUNTERS, np.uint32)
        shift = np.uint64(64 - COUNTERS.bit_length() + 1)
        held, size = [], 0

        def tally() -> None:
            table[:] += np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            held.clear()

        for batch in batches:
            for text in batch.column(0):
                held.append(shingler.set_of(text.as_py()))
                size += len(held[-1])
                if size >= COUNTERS:
                    tally()
                    size = 0
        if held:
            tally()
        parts = table.reshape(SLICES, -1)
        yield pa.RecordBatch.from_pydict({"slice": list(range(SLICES)), "counts": [C.planes(p) for p in parts]}, pa.schema([("slice", pa.int32()), ("counts", pa.binary())]))

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([C.from_planes(c, "<u4") for c in frame["counts"]], axis=0, dtype=np.uint64)
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "counts": [np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()]})

    ddl = "slice int, counts binary"
    rows = docs.select("text").mapInArrow(handing_back(count), ddl).groupBy("slice").applyInPandas(add, ddl).collect()  # SLICES rows, 8 MB in all
    return np.concatenate([np.frombuffer(r["counts"], "<u4") for r in sorted(rows, key=lambda r: r["slice"])]) if rows else np.zeros(COUNTERS, np.uint32)


_SET_DDL = "doc_id long, node long, n long, prefix binary, histogram binary, scan double"


def sets(docs: DataFrame, n: int, t100: int, table: np.ndarray) -> DataFrame:
    """Per row: id, class (null for empty sets), size, first elements in rare-first order, histogram, cost of scanning its lists."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # COUNTERS numbers
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("prefix", pa.binary()), ("histogram", pa.binary()), ("scan", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, out, counts = Shingler(n), Batcher(schema), shared.value
        mean, shift = counts.mean(), np.uint64(64 - COUNTERS.bit_length() + 1)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingler.set_of(text.as_py())
                if not len(s):
                    yield from out.add((doc_id, None, 0, None, None, 0.0))
                    continue
                node = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                first, scan = b"", 0.0
                if prefix_length(len(s), t100) or prefix_length(len(s) * 100 // t100, t100):  # else only equal sets link
                    c = counts[(s >> shift).astype(np.int64)]
                    order = np.lexsort((s, c))[: prefix_length(len(s), t100) + SUBSET]
                    first, scan = s[order].tobytes(), float(np.log2(1 + np.maximum(c[order] - mean, 0)).sum())
                histogram = np.bincount((s % np.uint64(HISTOGRAM)).astype(np.int64), minlength=HISTOGRAM)
                yield from out.add((doc_id, node, len(s), first, np.minimum(histogram, 0xFFFF).astype("<u2").tobytes(), scan), 400 + len(first))
        yield out.flush()

    return docs.select("doc_id", "text").mapInArrow(handing_back(run), _SET_DDL)


def boundary(classes: DataFrame, t100: int) -> int:
    """The size from which sets are heavy: where subsets cost more than lists, over all classes.

    A list costs each member its row and the comparison with the leader, and a long list, about
    whose other members the leader decides in most cases, the logarithm of its length besides.
    """
    misses = F.least(F.col("n") - F.ceil(F.col("n") * t100 / 100), F.lit(64))
    rows = {r["misses"]: (r["sets"], r["scan"]) for r in classes.where("length(prefix) > 0").groupBy(misses.alias("misses")).agg(F.count("*").alias("sets"), F.sum("scan").alias("scan")).collect()}  # at most 65 rows
    light = {a: k * ((a + SUBSET) * (a + SUBSET - 1) // 2) for a, (k, _) in rows.items()}
    heavy = {a: k * (a + 1) + scan for a, (k, scan) in rows.items()}
    costs = [(sum(x for a, x in light.items() if a < cut) + sum(x for a, x in heavy.items() if a >= cut), cut) for cut in range(65)]
    cut = min(costs)[1]
    n = 1
    while prefix_length(n, t100) < cut:
        n += 1
    return n


def signatures(classes: DataFrame, edge: int, t100: int) -> DataFrame:
    """(sig, node, n, rep): subsets of light sets, single first elements of heavy ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (f.iloc[i : i + SLICE] for f in frames for i in range(0, len(f), SLICE)):
            sigs, counts = [], []
            for n, prefix in zip(frame["n"], frame["prefix"], strict=True):
                first, own = np.frombuffer(prefix, "<u8"), []
                if n < edge:
                    i, j = np.triu_indices(len(first), 1)
                    own.append(C.mixed(C.mixed(np.minimum(first[i], first[j])) + np.maximum(first[i], first[j])))
                if 100 * n >= t100 * edge:
                    own.append(first[: prefix_length(n, t100) + 1])
                own = np.unique(np.concatenate(own))
                sigs.append(own.view(np.int64))
                counts.append(len(own))
            yield pd.DataFrame({"sig": np.concatenate(sigs), "node": np.repeat(frame["node"].to_numpy(), counts), "n": np.repeat(frame["n"].to_numpy(), counts), "rep": frame["rep"].astype("Int64").array.repeat(counts)})

    return classes.where("length(prefix) > 0").select("node", "n", "prefix", "rep").mapInPandas(handing_back(run), "sig long, node long, n long, rep long")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, t100: int) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets are similar enough, staged."""
    pairs = pairs if is_staged(pairs) else staged(pairs, "pairs")
    needed = staged(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes.select("node", "rep"), "node").select("node", "rep"), "needed")
    ids = needed.select(F.col("rep").alias("doc_id")).distinct()
    if needed.count() <= SMALL:
        ids = F.broadcast(ids)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    schema = pa.schema([("node", pa.int64()), ("elements", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, out = Shingler(n), Batcher(schema)
        for batch in batches:
            for text in batch.column(0):
                s = shingler.set_of(text.as_py())
                if len(s):
                    yield from out.add((xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), s.view(np.int64)), 8 * len(s))
        yield out.flush()

    found = staged(texts.select("text").mapInArrow(handing_back(run), "node long, elements array<long>").join(needed.select("node"), "node", "left_semi").groupBy("node").agg(F.first("elements").alias("elements")), "sets")

    # whole sets meet in the join's own rows: batches of thousands of them would be hundreds of MB beside the heap
    both = F.size(F.array_intersect("of_a", "of_b"))
    joined = pairs.join(found.withColumnsRenamed({"node": "b", "elements": "of_b"}), "b").join(found.withColumnsRenamed({"node": "a", "elements": "of_a"}), "a")
    links = staged(joined.where(100 * both >= t100 * (F.size("of_a") + F.size("of_b") - both)).select("a", "b"), "links")
    dropped(pairs, needed, found)
    return links


def _possible(pairs: DataFrame, shapes: DataFrame, t100: int) -> DataFrame:
    """Pairs (a, b) that the histograms don't reject."""

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x, y = (np.stack([np.frombuffer(h, "<u2") for h in frame[c]]).astype(np.int32) for c in ("ha", "hb"))
                yield frame.loc[bound(x, frame["na"].to_numpy(), y, frame["nb"].to_numpy(), t100), ["a", "b"]]

    shaped = pairs.join(shapes.withColumnsRenamed({"node": "a", "n": "na", "histogram": "ha"}), "a").join(shapes.withColumnsRenamed({"node": "b", "n": "nb", "histogram": "hb"}), "b")
    return shaped.select("a", "b", "na", "nb", "ha", "hb").mapInPandas(handing_back(keep), "a long, b long")


def _open(lists: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with their components, lists whose members are in several components)."""
    named = lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).where("low < high").select("sig", "members")
    return named, several


def _across_short(lists: DataFrame, labels: DataFrame, shapes: DataFrame, t100: int) -> DataFrame:
    """Pairs across components in lists of at most SHORT members, by a join on the list."""
    named, several = _open(lists, labels)
    rows = named.join(several.where(F.col("members") <= SHORT).select("sig"), "sig")
    other = rows.select("sig", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    near = F.least("n", "nb") * 100 >= F.greatest("n", "nb") * t100
    met = rows.join(other, "sig").where((F.col("component") < F.col("cb")) & near)
    return _possible(met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), shapes, t100)


def _across(lists: DataFrame, labels: DataFrame, classes: DataFrame, t100: int, forest: bool) -> DataFrame:
    """Pairs across components, in longer lists, that the histograms don't reject.

    With ``forest``, a list gives only as many pairs as may connect its components.
    """
    named, several = _open(lists, labels)
    open_lists = several.where(F.col("members") > SHORT).select("sig", F.ceil(F.col("members") / BLOCK).cast("int").alias("parts"))
    rows = named.join(open_lists, "sig").join(classes.select("node", "histogram"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # a member goes to every pair of blocks that has its own
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "node"])
        n, node, component = (frame[c].to_numpy() for c in ("n", "node", "component"))
        shape = np.stack([np.frombuffer(h, "<u2") for h in frame["histogram"]]).astype(np.int32)
        block, low, high = frame["own"].to_numpy(), frame["low"].iloc[0], frame["high"].iloc[0]
        out, parent = [], {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        for i in range(len(n)):
            upto = np.searchsorted(n, n[i] * 100 // t100, "right")
            js = np.arange(i + 1, upto)
            js = js[(component[js] != component[i]) & (True if low == high else block[js] != block[i])]
            js = js[bound(shape[js], n[js], shape[i], n[i], t100)] if len(js) else js
            for j in js.tolist():
                if forest:
                    x, y = root(int(component[i])), root(int(component[j]))
                    if x == y:
                        continue
                    parent[x] = y
                out.append((min(node[i], node[j]), max(node[i], node[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.select("sig", "node", "n", "component", "histogram", "own", "low", "high").groupBy("sig", "low", "high").applyInPandas(scan, "a long, b long").distinct()


def linked_components(docs: DataFrame, n: int = 3, t100: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links reach)."""
    if not 70 <= t100 <= 100:
        raise ValueError("the similarity has to be from 70 to 100 hundredths")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = staged(sets(docs, n, t100, counters(docs, n)), "shingle-sets")
    classes = staged(own.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("histogram").alias("histogram"), F.first("scan").alias("scan")), "classes")
    sigs = signatures(classes, boundary(classes, t100), t100)
    leaders = sigs.groupBy("sig").agg(F.min(F.struct("rep", "node", "n")).alias("leader"), F.count("*").alias("members")).where("members > 1").select("sig", F.col("leader.node").alias("leader"), F.col("leader.n").alias("leader_n"))
    lists = staged(sigs.drop("rep").join(leaders, "sig"), "lists")
    near = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * t100
    stars = lists.where((F.col("node") != F.col("leader")) & near).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    shapes = classes.select("node", "n", "histogram")

    links = _verified(_possible(stars, shapes, t100), docs, classes, n, t100)
    labels = components(links)
    members = lists.select("sig", "node", "n")

    def grown(pairs: DataFrame) -> bool:
        """Whether there were pairs; those that are verified join the links."""
        nonlocal links, labels
        pairs = staged(pairs, "candidates")
        if not pairs.limit(1).count():
            return False
        new = _verified(pairs, docs, classes, n, t100)
        if new.limit(1).count():
            links = links.unionByName(new)
            labels = components(links)
        return True

    grown(_across_short(members, labels, shapes, t100))
    if grown(_across(members, labels, classes, t100, forest=True)):
        grown(_across(members, labels, classes, t100, forest=False))
    named = classes.select("node", "rep").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = named.select("node", "component").join(lowest, "component").select("node", "component_id")
    done = own.select("doc_id", "n", "node").join(of_class, "node", "left")
    done = staged(done.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "components")
    dropped(own, classes, lists)
    return done
