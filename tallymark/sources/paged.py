"""A paged export as a data source: landed pages, read whole or not at all.

A provider gives its records in pages of a fixed size, told apart by how many records come before, until
a page is short. Pages land in a folder as ``page-<skip>.json``, each an object with ``skip``,
``count`` and ``items``. The source has a partition for each page. It holds the pages against each
other before anything is read, and each page against its own count while it is read, so that a page
that is missing, cut, repeated under another name or follows a short one ends the read with an error:
a snapshot that lacks records would make settlements look contradicted.

    spark.dataSource.register(LandedPages)
    spark.read.format("landed_pages").option("page", 1000).load(folder)   # skip, idx, item

Defined results: ``item`` is a record as JSON text, whatever its type; an export without
records is one empty page; a folder without pages is no connection, which is an error, not an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from tallymark.sources.shared import stored

PAGE = 1_000
_NAME = re.compile(r"page-(\d+)\.json")
_SCHEMA = pa.schema([("skip", pa.int64()), ("idx", pa.int64()), ("item", pa.string())])


class NotConnected(RuntimeError):
    """There is nothing to read from."""


class PartialSnapshot(RuntimeError):
    """The pages aren't a whole export."""


@dataclass(frozen=True)
class Page(InputPartition):
    path: str
    skip: int
    last: bool


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}")


def pages(path: str, page: int = PAGE) -> list[Page]:
    """The export's pages in order; an error if one is missing."""
    if page < 1:
        raise ValueError("a page holds one record at least")
    files, root = _folder(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    skips = sorted((int(m[1]), f.path) for f in found if (m := _NAME.fullmatch(f.base_name)))
    if not skips:
        raise NotConnected(f"no page in {path}")
    for k, (skip, name) in enumerate(skips):
        if skip != k * page:
            raise PartialSnapshot(f"{name} stands where the page after {k * page} records should be")
    return [Page(name, skip, k == len(skips) - 1) for k, (skip, name) in enumerate(skips)]


class _Reader(DataSourceReader):
    def __init__(self, path: str, page: int):
        self.path, self.page = path, page

    def partitions(self) -> list[Page]:
        return pages(self.path, self.page)

    def read(self, part: Page) -> Iterator[pa.RecordBatch]:
        files, _ = _folder(self.path)
        with files.open_input_stream(part.path) as f:
            raw = f.read()
        try:
            body = json.loads(raw)
            skip, items = body["skip"], body["items"]
            whole = isinstance(items, list) and body["count"] == len(items)
        except (ValueError, KeyError, TypeError) as e:
            raise PartialSnapshot(f"{part.path} is no page: {e}") from e
        if not whole or skip != part.skip:
            raise PartialSnapshot(f"{part.path} doesn't hold what it says")
        if len(items) > self.page or (len(items) < self.page) != part.last:
            raise PartialSnapshot(f"{part.path} holds {len(items)} records, and it is {'' if part.last else 'not '}the last page")
        texts = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in items]
        yield pa.RecordBatch.from_arrays([pa.array([skip] * len(items), pa.int64()), pa.array(range(skip, skip + len(items)), pa.int64()), pa.array(texts, pa.string())], schema=_SCHEMA)


class LandedPages(DataSource):
    """(skip, idx, item) of every record of a landed export."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return "skip long, idx long, item string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        if not self.options.get("path"):
            raise NotConnected("no folder is named")
        return _Reader(self.options["path"], int(self.options.get("page", PAGE)))


def fetch(spark: SparkSession, path: str, page: int = PAGE) -> DataFrame:
    """The whole export, or an error."""
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_pages").option("page", page).load(path)


def status(path: str, page: int = PAGE) -> dict[str, object]:
    """Whether the source can be read, and if not, why; never an error."""
    try:
        found = pages(path, page)
    except (NotConnected, PartialSnapshot) as e:
        return {"provider": "landed_pages", "connected": not isinstance(e, NotConnected), "complete": False, "pages": 0, "note": str(e)}
    return {"provider": "landed_pages", "connected": True, "complete": True, "pages": len(found), "note": "read-only"}


def land(items: DataFrame, path: str, page: int = PAGE) -> int:
    """Write (key, item: JSON text) as pages in order of key; gives their number.

    Records are numbered from the counts of the sorted table's parts, and a page is a group of ``page``
    records. A task that runs again writes the same page again.
    """
    sorted_rows = stored(items.select("key", "item").orderBy("key", "item").withColumn("at", F.monotonically_increasing_id()), "landing").withColumn("part", F.shiftright("at", 33))
    parts = sorted_rows.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"))  # a row for each part
    idx = F.col("at") + F.col("shift")
    grouped = sorted_rows.join(F.broadcast(before), "part").select((idx - idx % page).alias("skip"), idx.alias("idx"), "item").groupBy("skip").agg(F.sort_array(F.collect_list(F.struct("idx", "item"))).alias("own"))  # page records at most
    total = sorted_rows.count()
    empty = items.sparkSession.range(int(total % page == 0)).select(F.lit(total).cast("long").alias("skip"), F.array().cast("array<struct<idx:bigint,item:string>>").alias("own"))
    texts = grouped.unionByName(empty).select("skip", F.concat(F.lit('{"skip":'), "skip", F.lit(',"count":'), F.size("own"), F.lit(',"items":['), F.array_join(F.col("own.item"), ","), F.lit("]}")).alias("text"))
    files, root = _folder(path)
    files.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = _folder(path)
        for batch in batches:
            for skip, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with own.open_output_stream(f"{at}/page-{skip:012d}.json") as f:
                    f.write(text.as_py().encode())
            yield batch.select([0])

    return texts.mapInArrow(write, "skip long").count()
