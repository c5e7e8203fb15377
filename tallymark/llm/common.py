"""Shared helpers: table access, staged tables in the shared folder, word rules, id folds."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but space and the controls 9 to 13.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space for ``str.split`` that is not a word separator here.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    if not text:
        return []
    return WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def cut(runs: list[str], step: int, longest: int = 64, size: int = 16) -> list[str]:
    """Runs over ``longest`` characters in pieces of ``size``, one every ``step``; the others as they are."""
    if max(map(len, runs), default=0) <= longest:
        return runs
    return [p for r in runs for p in ([r] if len(r) <= longest else [r[i : i + size] for i in range(0, len(r) - size + step, step)])]


def lower_ascii(text: str) -> str:
    """A to Z in lower case, everything else unchanged."""
    return text.lower() if text.isascii() else text.encode().lower().decode()  # of bytes, only A to Z have a lower case


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % k


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder that goes with the
    process; on a cluster this is an error, since a machine-local folder would lose rows.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tallymark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/tallymark/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: this cuts the lineage, and a lost
    executor costs only a new read."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def is_staged(df: DataFrame) -> bool:
    return getattr(df, "_stored_at", None) is not None


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: whatever was made from them is staged itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released() -> None:
    """Give memory that a task no longer uses back to the system: Python workers are used again
    by later tasks, which shouldn't find the last one's peak still held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def handing_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives its memory back to the system at its end."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        released()

    return whole


class Batcher:
    """Collects output rows and gives Arrow batches of bounded bytes."""

    def __init__(self, schema: pa.Schema, most_bytes: int = 4 << 20):
        self.schema, self.most, self.rows, self.held = schema, most_bytes, [], 0

    def add(self, row: tuple, n_bytes: int = 64) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += n_bytes
        if self.held >= self.most:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.schema, strict=True)], schema=self.schema)
