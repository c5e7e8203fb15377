"""Chunks of encoded texts, and questions that chunks put to a distributed table of keys.

A chunk holds the words of many documents as codes into its own word list. What an operator
has to know about its words or n-grams across the corpus it asks in bulk: each chunk sends
its distinct keys, with what it has counted for them, to buckets by key range; a bucket merges
the keys of all chunks and answers each chunk in the order it asked. A key that stands in a
third of all rows is one entry for each chunk, so no bucket is hot, and a bucket's size follows
from the number of buckets, which grows with the keys asked for.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import lower_ascii, words

CHUNK_BYTES = 10 << 20
#: ids, known (1 where the id isn't null), flags and lengths are arrays of the documents; codes of their words by place value.
CHUNK_DDL = "chunk long, ids binary, known binary, flags binary, lengths binary, vocab binary, codes binary"
_CHUNK = pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("ids", "known", "flags", "lengths", "vocab", "codes"))])


def encode(docs: DataFrame, lower: bool = False, flag: Column | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of all rows: stage it before use, chunk numbers belong to one run.

    ``flag`` is a condition that is kept with each document.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.coalesce((F.lit(0) if flag is None else flag).cast("int"), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, flags, lengths, codes, vocab, held = [], [], [], array("i"), {}, 0

        def give() -> pa.RecordBatch:
            row = ([number], [array("q", [i or 0 for i in ids]).tobytes()], [bytes(i is not None for i in ids)], [bytes(flags)], [array("q", lengths).tobytes()], ["\n".join(vocab).encode()], [planes(np.frombuffer(codes, np.int32)) if codes else b""])
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _CHUNK, strict=True)], schema=_CHUNK)

        for batch in batches:
            for doc_id, text, mark in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py() or ""
                own = words(lower_ascii(text) if lower else text)
                codes.extend([vocab.setdefault(w, len(vocab)) for w in own])
                ids.append(doc_id)
                flags.append(mark)
                lengths.append(len(own))
                held += len(text) + 16
                if held >= chunk_bytes:
                    yield give()
                    number += 1
                    ids, flags, lengths, codes, vocab, held = [], [], [], array("i"), {}, 0
        if ids:
            yield give()

    return rows.mapInArrow(run, CHUNK_DDL)


def documents(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, whether they are known, flags and numbers of words of a chunk's documents."""
    return np.frombuffer(row.ids, "<i8"), np.frombuffer(row.known, np.uint8).astype(bool), np.frombuffer(row.flags, np.uint8), np.frombuffer(row.lengths, "<i8")


def codes_of(row) -> np.ndarray:
    """Codes of all words of a chunk's documents, one document after the other."""
    return from_planes(row.codes, "<i4")


def id_column(ids: np.ndarray, known: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(np.array(ids, np.int64), ~known)


def word_list(vocab: bytes) -> list[bytes]:
    return bytes(vocab).split(b"\n") if vocab else []


def word_hashes(vocab: bytes) -> np.ndarray:
    """64-bit hashes of a chunk's words, in order of their codes."""
    h = xxhash.xxh3_64_intdigest
    return np.array([h(w) for w in word_list(vocab)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over their whole range (two multiply-xor rounds)."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def planes(values: np.ndarray) -> bytes:
    """An array's bytes by place value, so that the compressor meets runs of zeros."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, by place value."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, "<u8"), dtype=np.uint64)


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Places at which ascending keys go over to the next of so many equal ranges."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def asked(kind: int, chunk: int, keys: np.ndarray, columns: list[np.ndarray], buckets: int) -> pd.DataFrame:
    """One row for each bucket: the chunk's ascending distinct keys and what it has for them."""
    at = bounds(keys, buckets)
    rows = [(kind, b, chunk, pack_keys(keys[i:j]), [planes(c[i:j]) for c in columns]) for b, (i, j) in enumerate(zip(at, at[1:], strict=False)) if j > i]
    return pd.DataFrame(rows, columns=["kind", "bucket", "chunk", "keys", "data"])


ASKED_DDL = "kind int, bucket int, chunk long, keys binary, data array<binary>"
ANSWER_DDL = "kind int, bucket int, chunk long, answer binary"


def merge(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """All keys of a bucket: the distinct ones, each asked key's place among them, each row's span."""
    parts = [unpack_keys(k) for k in frame["keys"]]
    distinct, place = np.unique(np.concatenate(parts), return_inverse=True)
    ends = np.cumsum([len(p) for p in parts])
    return distinct, place, [slice(e - len(p), e) for e, p in zip(ends, parts, strict=True)]


def answered(questions: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame], ddl: str = ANSWER_DDL) -> DataFrame:
    """Group questions by kind and bucket and answer them."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return answer(frame)

    return questions.groupBy("kind", "bucket").applyInPandas(run, ddl)


def with_answers(chunk_table: DataFrame, answers: DataFrame) -> DataFrame:
    """The chunk table with column ``answers``: (kind, bucket, answer) of each chunk.

    A chunk gets at most one answer for each kind and bucket, as long as its own questions.
    """
    own = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("kind", "bucket", "answer"))).alias("answers"))
    return chunk_table.join(own, "chunk", "left")


def answer_of(answers, kind: int, dtype: str) -> np.ndarray:
    """A chunk's answers of one kind, in the order of its ascending keys."""
    parts = [from_planes(bytes(a["answer"]), dtype) for a in (answers if answers is not None else ()) if a["kind"] == kind]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
