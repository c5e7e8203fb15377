"""A Merkle manifest of a dataset: a leaf for each row, a tree for each group, a root over the groups.

Nodes are numbered within their group in order of key, and a window over each run of sixteen
(partitioned by group and parent, with an ordered list over its whole frame) gives the run's
members: their digests in a row are what the parent is made of, and without a node's own they
are its siblings. The first member of a run stands for its parent at the next level. From the
top down every node then gets its path: what stands before and after it on each level up to the
root. Only digests travel, each level holds a sixteenth of the last one, and no run has more
than sixteen rows however large its group is. A group's numbers come from the stored order: the
counts of each part of the sorted table, summed over the parts before it.

Defined results: values may be null in any column; a null group comes first and counts as a
group, null keys come before others, equal keys are in order of their leaf, and a repeated row
is a leaf of its own. An empty table has no leaf and no root. Columns that aren't asked for play
no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.llm.common import staged

#: Members of a run, and so children of a node.
FAN = 16
PATH = "array<struct<before:string,after:string>>"


def sealed(text: Column) -> Column:
    """Lower-case hex SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row: each value as its byte count, a colon and itself; a dash for null."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return sealed(F.concat(*parts))


def leaves(df: DataFrame, columns: Sequence[str], group_col: str, key_col: str, changed: Mapping[str, Column] | None = None) -> DataFrame:
    """(g, key, digest, other): a row's group, key and leaf, and its leaf with ``changed`` in place of some columns."""
    group, own = F.col(group_col).cast("string"), [F.col(c) for c in columns]
    other = [(changed or {}).get(c, F.col(c)) for c in columns]
    return df.select(
        F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), group)).alias("g"),
        F.col(key_col).alias("key"), leaf(own).alias("digest"), leaf(other).alias("other"),
    )


def numbered(nodes: DataFrame, order: Sequence[Column]) -> DataFrame:
    """nodes with ``idx``, their place in their group ``g`` from 0, and ``n``, the group's size.

    The sort splits equal rows too, so that no part of the sorted table holds more than its share.
    """
    placed = nodes.withColumn("_at", F.monotonically_increasing_id()).orderBy("g", *order, "_at").drop("_at")
    kept = staged(placed.withColumn("_mid", F.monotonically_increasing_id()), "merkle-order").withColumn("_part", F.shiftright("_mid", 33))
    parts = kept.groupBy("g", "_part").agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy("g").orderBy("_part")
    whole = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("g", "_part", (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    return kept.join(parts, ["g", "_part"]).withColumn("idx", F.col("_mid") + F.col("_shift")).drop("_mid", "_part", "_shift")


def with_runs(nodes: DataFrame) -> DataFrame:
    """Every node of groups with several ones, with ``parent`` and ``run``, the digests of its run in order."""
    run = Window.partitionBy("g", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inner = nodes.where("n > 1").withColumn("parent", F.expr(f"idx div {FAN}"))
    return inner.withColumn("run", F.collect_list("digest").over(run))


def raised(nodes: DataFrame) -> DataFrame:
    """The next level: each run's first member gives the parent's digest."""
    first = with_runs(nodes).where(F.col("idx") % FAN == 0)
    return first.select("g", F.col("parent").alias("idx"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), sealed(F.array_join("run", "")).alias("digest"))


def grown(nodes: DataFrame) -> list[DataFrame]:
    """All levels of the trees, (g, idx, n, digest) each, stored; a group is done where n is 1."""
    levels = [nodes.select("g", "idx", "n", "digest")]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(staged(raised(levels[-1]), "merkle-level"))
        most = -(-most // FAN)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(g, digest): the node that remains of each group."""
    done = [level.where("n = 1").select("g", "digest") for level in levels]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def step(at: Column, run: Column) -> Column:
    """What stands before and after a node in its run, as an entry of a path."""
    place = (at % FAN).cast("int")
    return F.struct(F.array_join(F.slice(run, F.lit(1), place), "").alias("before"), F.array_join(F.slice(run, place + 2, F.lit(FAN)), "").alias("after"))


def paths(levels: list[DataFrame], above: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (of the lowest level, with columns of their own) with ``path`` and the columns of ``above``.

    ``above`` has for each group ``path``, from its top node on, and columns to hand down.
    """
    more = [c for c in above.columns if c != "g"]
    known = None
    for level in [*reversed(levels[1:]), nodes]:
        own = [c for c in level.columns if c not in ("g",)] if level is nodes else ["idx"]
        out = level.where("n = 1").join(above, "g").select("g", *own, *more)
        if known is not None:
            up = known.select("g", F.col("idx").alias("parent"), *more)
            inner = with_runs(level).join(up, ["g", "parent"]).withColumn("path", F.concat(F.array(step(F.col("idx"), F.col("run"))), "path"))
            out = out.unionByName(inner.select("g", *own, *more))
        known = out
    return known


def manifest(leaf_table: DataFrame) -> DataFrame:
    """leaves() with idx, n, subroot, root and path, from the leaf up to the root."""
    nodes = numbered(leaf_table, [F.col("key").asc_nulls_first(), F.col("digest")])
    levels = grown(nodes)
    groups = numbered(staged(tops(levels).select(F.lit("").alias("g"), F.col("g").alias("group"), "digest"), "merkle-groups"), [F.col("group")])
    upper = grown(groups)
    top = tops(upper).first()  # one row: the groups form one tree
    start = groups.sparkSession.createDataFrame([("",)], "g string").select("g", F.array().cast(PATH).alias("path"))
    placed = paths(upper, start, groups)
    above = placed.select(F.col("group").alias("g"), F.col("digest").alias("subroot"), F.lit(top["digest"] if top else None).cast("string").alias("root"), "path")
    return paths(levels, above, nodes)


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return sealed(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(path: Column, start: Column) -> Column:
    """The root that a path's siblings and a leaf give."""
    return F.aggregate(path, start, lambda have, s: sealed(F.concat(s["before"], have, s["after"])))


def verified(df: DataFrame, columns: Sequence[str], group_col: str, key_col: str, changed: Mapping[str, Column] | None = None) -> DataFrame:
    """Each row's key, leaf, subroot, root, proof_sha256, and folded_root and verified of its changed columns."""
    rows = manifest(leaves(df, columns, group_col, key_col, changed)).withColumn("folded_root", folded(F.col("path"), F.col("other")))
    return rows.select(
        F.col("key").alias(key_col), F.col("digest").alias("leaf"), "subroot", "root",
        proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
