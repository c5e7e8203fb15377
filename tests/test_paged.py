"""Landed pages: the whole export or an error."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallymark.sources import paged


def landed(spark, folder, n, page=10):
    items = spark.range(n).select(F.col("id").alias("key"), F.to_json(F.struct("id", F.lit("ü \"x\"").alias("name"))).alias("item")).repartition(5)
    return paged.land(items, str(folder), page)


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 40, 237])
def test_pages_hold_the_table(spark, tmp_path, n):
    assert landed(spark, tmp_path / "p", n) == n // 10 + 1
    got = sorted(paged.fetch(spark, str(tmp_path / "p"), 10).collect())
    assert [(r.skip, r.idx) for r in got] == [(k // 10 * 10, k) for k in range(n)]
    assert [json.loads(r.item) for r in got] == [{"id": k, "name": 'ü "x"'} for k in range(n)]
    assert paged.fetch(spark, str(tmp_path / "p"), 10).rdd.getNumPartitions() == n // 10 + 1
    assert paged.status(str(tmp_path / "p"), 10) == {"provider": "landed_pages", "connected": True, "complete": True, "pages": n // 10 + 1, "note": "read-only"}


def page_file(folder, skip):
    return folder / f"page-{skip:012d}.json"


def changed(folder, at, **more):
    f = page_file(folder, at)
    f.write_text(json.dumps(json.loads(f.read_text()) | more))


BREAKS = {
    "a page is missing": lambda p: page_file(p, 10).unlink(),
    "the first page is missing": lambda p: page_file(p, 0).unlink(),
    "the last page is missing": lambda p: page_file(p, 30).unlink(),
    "a page is cut": lambda p: page_file(p, 20).write_text(page_file(p, 20).read_text()[:-30]),
    "a page lacks records": lambda p: changed(p, 10, items=[], count=0),
    "a count is wrong": lambda p: changed(p, 10, count=9),
    "a page stands under another name": lambda p: changed(p, 20, skip=10),
    "a page stands between": lambda p: page_file(p, 15).write_text(page_file(p, 10).read_text()),
    "a page is too long": lambda p: changed(p, 30, items=[1] * 11, count=11),
    "a page follows a short one": lambda p: page_file(p, 40).write_text('{"skip":40,"count":0,"items":[]}'),
    "a page isn't an object": lambda p: page_file(p, 10).write_text("[]"),
    "items aren't a list": lambda p: changed(p, 10, items={"a": 1}, count=1),
}


@pytest.mark.parametrize("broken", BREAKS, ids=lambda x: x.replace(" ", "-"))
def test_a_broken_export_is_an_error(spark, tmp_path, broken):
    landed(spark, tmp_path / "p", 35)
    BREAKS[broken](tmp_path / "p")
    with pytest.raises(Exception, match="PartialSnapshot|page"):
        paged.fetch(spark, str(tmp_path / "p"), 10).collect()


def test_no_connection_is_an_error(spark, tmp_path):
    for at in (tmp_path / "none", tmp_path):
        with pytest.raises(Exception, match="no page"):
            paged.fetch(spark, str(at)).collect()
        assert not paged.status(str(at))["connected"]
    with pytest.raises(ValueError):
        paged.pages(str(tmp_path), 0)
