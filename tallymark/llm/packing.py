"""Best-fit packing planned on a histogram of lengths.

Texts become token counts once, in a staged table of pieces. Best fit in descending order of
length runs on the driver over the counts of lengths (at most ``capacity`` numbers, however
many documents there are): it gives runs of slots, "so many pieces of this length, so many to a
sequence, from this sequence and offset on". The runs are spread out into a table of slots and
the pieces take them by a join on length and rank within length. Ranks are counted in salted
groups, so that one very common length doesn't meet in one task.

Defined results: null and empty texts are packed as the end token alone; every row is packed,
repeated rows as often as they stand there; a null id is kept; an empty table has no pieces; other
columns are left out, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.llm import bpe
from tallymark.llm.common import Batcher, released, staged

CAPACITY = 4096
#: The token that ends a document.
END = 1
#: Slots spread out by one row, and rows that one salted group is meant to hold.
SPREAD, GROUP = 1 << 16, 50_000
#: Column with the number of a stored piece.
_ROW = "_piece_row"


def token_pieces(df: DataFrame, vocab: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids)."""
    kind = dict(df.dtypes)[id_col]
    fields = [("id", pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    ddl = "id string, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        fields, ddl = [*fields, ("ids", pa.list_(pa.int32()))], ddl + ", ids array<int>"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, out, end = bpe.LibraryBPE(vocab), Batcher(schema), END.to_bytes(4, "little")
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = b"".join([*model.packed(text.as_py()), end])
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    more = (array("I", part).tolist(),) if with_ids else ()
                    yield from out.add((key, k, at // 4, len(part) // 4, zlib.crc32(part), *more), 64 + len(part) * with_ids)
        yield out.flush()
        del model, out, batches
        released()

    wide = df.selectExpr(f"cast(`{id_col}` as string) as id", f"cast(`{text_col}` as string) as text").mapInArrow(run, ddl)
    return wide.selectExpr(f"cast(id as {kind}) as `{id_col}`", *wide.columns[1:])


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts.

    Gives runs (length, first rank, pieces, first sequence, pieces in a sequence, offset).
    Sequences with the same room left are handled together, so the work follows the number
    of different lengths and rooms.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, sequences)
    sizes: list[int] = []  # the rooms that have sequences, ascending
    opened = 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if not room[left]:
                bisect.insort(sizes, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                left = sizes[at]
                first, n = room[left].pop()
                if not room[left]:
                    sizes.pop(at)
            else:
                left, first = capacity, opened
                n = -(-todo // (capacity // length))
                opened += n
            fit = left // length
            whole = min(n, todo // fit)
            if whole:
                runs.append((length, rank, whole * fit, first, fit, capacity - left))
                put(left - fit * length, first, whole)
                rank, todo = rank + whole * fit, todo - whole * fit
            if whole < n:
                some = min(todo, fit - 1) if todo < fit else 0
                if some:
                    runs.append((length, rank, some, first + whole, some, capacity - left))
                    put(left - some * length, first + whole, 1)
                    rank, todo = rank + some, todo - some
                put(left, first + whole + bool(some), n - whole - bool(some))
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (id, piece, start, length, ...).

    Ranks are counted in groups dealt by a stored row number, so that rows which share an id are spread too.
    """
    spark, columns = pieces.sparkSession, [c for c in pieces.columns if c != _ROW]
    if _ROW not in pieces.columns:
        pieces = staged(pieces.withColumn(_ROW, F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs = plan(histogram, capacity)
    slots = (
        spark.createDataFrame(runs, "length long, first_rank long, n long, first_sequence long, fit long, at long")
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SPREAD).cast("long"))).alias("base"))
        .repartition("length", "base", "first_rank")
        .select("*", F.explode(F.sequence("base", F.least(F.col("base") + SPREAD - 1, F.col("n") - 1))).alias("j"))
        .selectExpr("length as slot_length", "first_rank + j as slot_rank", "first_sequence + j div fit as sequence_id", "at + (j % fit) * length as offset")
    )
    salts = max(8, -(-max(histogram.values(), default=1) // GROUP))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(F.col(_ROW)), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    )
    ranked = (
        salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy(id_col, "piece", "start", "ids_crc32")))
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("own") - 1)
    )
    joined = ranked.join(slots, (ranked["length"] == slots["slot_length"]) & (ranked["rank"] == slots["slot_rank"]))
    return joined.select(*[pieces[c] for c in columns], "sequence_id", F.col("offset"))


def pack_documents(df: DataFrame, vocab: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack all rows: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    own = token_pieces(df, vocab, capacity, id_col, text_col, with_ids).withColumn(_ROW, F.monotonically_increasing_id())
    return pack(staged(own, "pieces"), capacity, id_col)
