"""Exact top-k by aggregation of sorted lists without random access.

Vectors become integers and are kept in blocks. In a block there is one list for each
dimension, sorted by value; for a query it is read from the end that gives its largest
products. Rows read so far have a lower bound (what was read, and the least the rest can give) and
an upper bound (what was read, and the frontiers of the lists not read for that row). Reading
goes on, all lists at the same depth, until no row outside the best k can still qualify, seen
or unseen; then the final scores of the rows that are left are resolved. The k-th score of
earlier blocks is the threshold that later blocks start from.

Queries meet vectors block by block: the grid of (query block, vector block) pairs is spread
over the cluster by an equi-join on vector length and parts of the block numbers, and each query's
best k of every partition are merged. Nothing is broadcast and no group is unbounded: a block holds ``BLOCK`` rows.

Defined results: null vectors and those with null, NaN or infinite components take no part,
neither as queries nor as candidates; a vector meets only vectors of its own length; rows
that repeat an id are rows of their own, so a query's candidates are all rows but the query's
own row; ties go to the smaller id; null ids take no part; empty tables give no rows; other
columns are left out, whatever their names; components whose scaled value or sums leave 64 bits raise an
error rather than wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import staged

BLOCK, QUERY_BLOCK = 4096, 256
#: Lists are read this many entries at a time at first; then in doubling steps.
DEPTH = 256


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, v): usable rows, each component as floor(scale * x) with x as double."""
    x = F.col(vec_col).cast("array<double>")
    usable = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("v"))


def blocks(ids_and_vectors: DataFrame) -> DataFrame:
    """(block, dim, ids, values): rows dealt into blocks of BLOCK rows, values as packed 64-bit integers."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def give(dim: int) -> pd.DataFrame:
            nonlocal number
            rows = held.pop(dim)
            number += 1
            return pd.DataFrame({"block": [(task << 32) + number], "dim": [dim], "ids": [np.array([r[0] for r in rows], "<i8").tobytes()], "cells": [np.array([r[1] for r in rows], "<i8").reshape(len(rows), dim).tobytes()]})

        for frame in frames:
            for key, v in zip(frame["id"], frame["v"], strict=True):
                rows = held.setdefault(len(v), [])
                rows.append((key, v))
                if len(rows) == BLOCK:
                    yield give(len(v))
        for dim in list(held):
            yield give(dim)

    return ids_and_vectors.mapInPandas(pack, "block long, dim int, ids binary, cells binary")


def merged(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    return np.lexsort((ids, -scores))[:k]


class SortedLists:
    """The lists of one block: for each dimension, rows by ascending value.

    Queries read their lists together: to the same depth, from the top where the weight is
    positive and from the bottom where it is negative. What all queries have read of all
    rows is then a few matrix products. Numbers are whole; they are held as doubles while
    every sum stays under 2**53, else as 64-bit integers.
    """

    def __init__(self, ids: np.ndarray, cells: np.ndarray):
        self.ids, self.cells = ids, cells
        order = np.argsort(cells, axis=0, kind="stable")
        self.sorted = np.take_along_axis(cells, order, 0)
        self.place = np.empty_like(order)  # of each row in each list
        np.put_along_axis(self.place, order, np.arange(len(cells))[:, None], 0)
        self.largest = int(np.abs(cells).max(initial=0))

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, floors: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the best k rows for each query, but for row ``own`` (-1: none).

        ``floors``: scores found before for each query; rows that can't enter the best k
        together with these may be left out.
        """
        n, dims = self.cells.shape
        most = self.largest * int(np.abs(queries).max(initial=0)) * max(1, dims)
        if most >= 1 << 62:
            raise OverflowError("inner products of these vectors can leave 64 bits")
        fits = most < 1 << 53
        kind = np.float64 if fits else np.int64
        cells, weights = self.cells.astype(kind), queries.astype(kind).T
        up, down = np.maximum(weights, 0), np.minimum(weights, 0)
        lowest = self.sorted[0].astype(kind)[:, None] * up, self.sorted[-1].astype(kind)[:, None] * down  # least products of each list
        live: list[np.ndarray | None] = [None] * len(queries)
        active, depth = np.arange(len(queries)), DEPTH
        least = np.array([np.sort(f)[-k] if len(f) >= k else np.iinfo(np.int64).min for f in floors], dtype=np.float64 if fits else np.int64)
        while len(active):
            depth = min(n, depth)
            high, low = self.place >= n - depth, self.place < depth  # what has been read, by end of the list
            high_cells, low_cells, high, low = cells * high, cells * low, high.astype(kind), low.astype(kind)
            edge_up = self.sorted[n - depth].astype(kind)[:, None] * up[:, active]  # frontiers: no unread product is larger
            edge_down = self.sorted[depth - 1].astype(kind)[:, None] * down[:, active]
            read = high_cells @ up[:, active] + low_cells @ down[:, active]
            upper = read + (edge_up.sum(0) + edge_down.sum(0)) - high @ edge_up - low @ edge_down
            worst_up, worst_down = lowest[0][:, active], lowest[1][:, active]
            lower = read + (worst_up.sum(0) + worst_down.sum(0)) - high @ worst_up - low @ worst_down
            hidden = np.flatnonzero(own[active] >= 0)
            nothing = -np.inf if fits else np.iinfo(np.int64).min
            upper[own[active[hidden]], hidden] = nothing
            lower[own[active[hidden]], hidden] = nothing
            cut = np.maximum(np.partition(lower, n - min(k, n), 0)[n - min(k, n)], least[active])
            open_rows = upper >= cut  # a row that was never read has the sum of the frontiers
            counts = open_rows.sum(0)
            done = (counts <= 4 * k) | (depth == n)
            for i in np.flatnonzero(done).tolist():
                live[active[i]] = np.flatnonzero(open_rows[:, i])
            active, depth = active[~done], depth * 2
        out = []
        for q, mine, rows in zip(queries, own.tolist(), live, strict=True):
            rows = rows[rows != mine]
            scores = self.cells[rows] @ q
            best = merged(self.ids[rows], scores, k)
            out.append((self.ids[rows[best]], scores[best]))
        return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by integer inner product.

    ``is_query`` is a condition on the column ``id``.
    """
    stored = staged(blocks(quantized(vectors, id_col, vec_col, scale)), "vector-blocks")
    spark = vectors.sparkSession

    def queries_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, dim, ids, places, cells in frame[["block", "dim", "ids", "places", "cells"]].itertuples(index=False):
                rows = np.asarray(places, np.int64)
                cells, ids = np.frombuffer(cells, "<i8").reshape(len(ids) // 8, dim), np.frombuffer(ids, "<i8")
                for part in range(0, len(rows), QUERY_BLOCK):
                    chosen = rows[part : part + QUERY_BLOCK]
                    yield pd.DataFrame({"query_block": [block * (BLOCK // QUERY_BLOCK) + part // QUERY_BLOCK], "dim": [dim], "query_ids": [ids[chosen].tobytes()], "own_block": [block], "own_rows": [chosen.tobytes()], "query_cells": [np.ascontiguousarray(cells[chosen]).tobytes()]})

    def ids_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, ids in zip(frame["block"], frame["ids"], strict=True):
                yield pd.DataFrame({"block": block, "id": np.frombuffer(ids, "<i8"), "place": np.arange(len(ids) // 8)})

    places = (
        stored.select("block", "ids").mapInPandas(ids_of, "block long, id long, place int").where(is_query)
        .groupBy("block").agg(F.sort_array(F.collect_list("place")).alias("places"))  # at most BLOCK
    )
    asked = stored.join(places, "block").select("block", "dim", "ids", "places", "cells").mapInPandas(
        queries_of, "query_block long, dim int, query_ids binary, own_block long, own_rows binary, query_cells binary"
    )
    # the grid: every query block is sent to each vector block of its dimension, where the
    # block itself comes first
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # one length of all vectors doesn't meet in one task
    numbers = stored.select("block", "dim", F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int").alias("part"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    columns = ["block", "kind", "dim", "ids", "cells", "query_block", "own_block", "own_rows"]
    sent = asked.join(numbers, ["dim", "part"]).selectExpr("block", "1 as kind", "dim", "query_ids as ids", "query_cells as cells", "query_block", "own_block", "own_rows")
    kept = stored.selectExpr("block", "0 as kind", "dim", "ids", "cells", "0L as query_block", "0L as own_block", "binary('') as own_rows")
    cores = max(1, spark.sparkContext.defaultParallelism)
    rows = kept.select(columns).unionByName(sent.select(columns)).repartition(4 * cores, "block").sortWithinPartitions("block", "kind", "query_block")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists: SortedLists | None = None
        best: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}  # query block: its rows' best so far
        rows_of: dict[int, np.ndarray] = {}

        def give(block: int) -> pd.DataFrame:
            found = best.pop(block)
            ids = rows_of.pop(block)
            sizes = [len(found[i][0]) for i in range(len(ids))]
            return pd.DataFrame({"query_id": np.repeat(ids, sizes), "query_row": np.repeat(block * QUERY_BLOCK + np.arange(len(ids)), sizes), "vec_id": np.concatenate([found[i][0] for i in range(len(ids))]), "score": np.concatenate([found[i][1] for i in range(len(ids))])})

        for frame in frames:
            for row in frame.itertuples(index=False):
                cells = np.frombuffer(row.cells, "<i8").reshape(len(row.ids) // 8, row.dim)
                if row.kind == 0:
                    lists = SortedLists(np.frombuffer(row.ids, "<i8"), cells)
                    continue
                asked_ids, own = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.own_rows, np.int64)
                state = best.setdefault(row.query_block, {})
                rows_of[row.query_block] = asked_ids
                nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                new = lists.top(cells, own if row.own_block == row.block else np.full(len(own), -1), k, [state.get(i, nothing)[1] for i in range(len(asked_ids))])
                for i, (ids, scores) in enumerate(new):
                    if i in state:
                        ids, scores = np.concatenate((state[i][0], ids)), np.concatenate((state[i][1], scores))
                        keep = merged(ids, scores, k)
                        ids, scores = ids[keep], scores[keep]
                    state[i] = (ids, scores)
                if len(best) > 64:
                    yield give(next(iter(best)))
        for block in list(best):
            yield give(block)

    found = rows.mapInPandas(search, "query_id long, query_row long, vec_id long, score long")
    # each query has k rows from every partition; the best are kept as sorted arrays
    best = found.groupBy("query_row", "query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
