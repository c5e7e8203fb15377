import hashlib
import random

from pyspark.sql import functions as F

from tallymark.llm.merkle import verified

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Beside the asked columns, some that clash with the operator's own names.
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, g string, idx long, n long, run string, path string, digest string, key long, parent long, other string, subroot string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(digests):
    """The top of one tree, and for each leaf its siblings (before, after) on each level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            paths[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at, level = [i // 16 for i in at], [h("".join(run)) for run in runs]
    return (level or [None])[0], paths


def brute_force(rows, changed):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in order:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        own[s] = (members, *climbed([leaf(r) for r in members]))
    root, above = climbed([own[s][1] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        members, subroot, paths = own[s]
        for r, path in zip(members, paths, strict=True):
            cur = leaf(changed(r))
            for before, after in path + up:
                cur = h(before + cur + after)
            out.append((r[0], leaf(r), subroot, root, h("".join(b + a for b, a in path + up)), cur, cur == root))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z", "d", 3, 4, "o", "s") for r in rows], SCHEMA)


def result(spark, rows):
    changed = F.when(F.col("doc_id") % 5 == 0, F.lower("text")).otherwise(F.col("text"))
    got = verified(frame(spark, rows), COLUMNS, "source", "doc_id", {"text": changed})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def lowered(r):
    return (*r[:4], r[4].lower() if r[4] is not None and r[0] is not None and r[0] % 5 == 0 else r[4])


def test_manifest_matches_brute_force(spark):
    """A source of 300 rows (three levels), one row, exactly 16 and 17, none, names out of order; nulls, repeats, equal ids."""
    rng = random.Random(5)
    rows = [(i, "hot", "en", i * 3, f"Text {i} ÄÖ") for i in range(300)]
    rows += [(1000, "alone", None, None, None), (1001, "", "de", 0, ""), (1002, "Z", "x", 1, "A"), (1003, "é", "x", 1, "B")]
    rows += [(2000 + i, "sixteen", "en", 1, "Q") for i in range(16)] + [(3000 + i, "seventeen", "en", 1, "q") for i in range(17)]
    rows += [(None, None, None, None, None), (None, None, "en", 5, "ABC"), (7, None, "en", 5, "ABC"), (7, None, "en", 5, "ABC"), (10, None, "en", 5, "abd"), (10, None, "en", 5, "ABD")]
    rows += [(4000 + i, f"s{i:02d}", "en", i, "W" * i) for i in range(20)] + [(5000, "long", "en", 200_000, "Word " * 40_000)]
    rng.shuffle(rows)
    want = brute_force(rows, lowered)
    got = result(spark, rows)
    assert got == want
    assert {r[6] for r in got} == {True, False}


def test_one_source_and_one_row(spark):
    for rows in ([(5, "a", "en", 1, "X")], [(5, "a", "en", 1, "x"), (6, "a", "en", 1, "Y")], [(5, "a", "en", 1, "X")] * 40):
        assert result(spark, rows) == brute_force(rows, lowered)


def test_an_empty_table_has_no_rows(spark):
    assert result(spark, []) == []


def test_a_hot_source_is_numbered_in_parts(spark):
    """No join or window of the numbering takes the hot source's rows by source alone."""
    from tallymark.llm.merkle import leaves, numbered

    rows = frame(spark, [(i, "hot" if i % 3 else f"s{i}", "en", i, "T") for i in range(900)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = numbered(leaves(rows, COLUMNS, "source", "doc_id"), [F.col("key"), F.col("digest")])
        plan = placed._jdf.queryExecution().executedPlan().toString()
        join = [line for line in plan.splitlines() if "SortMergeJoin" in line]
        assert join and all("_part" in line for line in join)
        spans = placed.groupBy("g").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.countDistinct("idx").alias("c"), F.max("n").alias("n")).collect()
        assert all((r.a, r.b, r.c) == (0, r.n - 1, r.n) for r in spans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
