"""Tables written to the folder that driver and executors share, to cut a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir.

    Where that is unset, a local master gets a folder that goes with the process; a cluster
    has to name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tallymark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/tallymark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that this process has stored, by session, name and the files they were made from.
_MADE: dict[tuple, DataFrame] = {}


def once(name: str, sources: tuple[DataFrame, ...], make: Callable[[], DataFrame]) -> DataFrame:
    """make(), stored and used again by later calls of the session over the same files.

    The key has the list of the sources' files: what is written anew has other files.
    """
    spark = sources[0].sparkSession
    files = tuple(sorted(f for s in sources for f in s.inputFiles()))
    key = (spark.sparkContext.applicationId, str(spark._jsparkSession), spark.conf.get("spark.checkpoint.dir", None), name, files)
    if key not in _MADE:
        made = stored(make(), name)
        _MADE[key[0], key[1], spark.conf.get("spark.checkpoint.dir", None), name, files] = made
        return made
    return _MADE[key]
