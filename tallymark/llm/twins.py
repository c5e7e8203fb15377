"""DuckDB SQL of the operators that SQL can express, beside the one in queries.py."""

from __future__ import annotations

#: crc32 of a text as a list of bytes, in CTEs: ``crc_table`` has the 256 steps of the reflected polynomial.
CRC_TABLE = """
    crc_table AS (
        SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
        FROM range(256) t(i)
    )"""


def crc(bytes_list: str) -> str:
    """SQL of the unsigned crc32 of a list of bytes, where ``steps`` is in scope."""
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_list}), lambda c, b: xor(c >> 8, steps[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295)"


def _levels(name: str, base: str) -> str:
    """All nodes above ``base`` (g, idx, n, digest), and the runs they are made of."""
    return f"""
    {name} AS (
        SELECT g, 0 AS lvl, idx, n, digest FROM {base}
        UNION ALL
        SELECT g, lvl + 1, idx // 16, max(n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY g, lvl, idx // 16
    ), {name}_runs AS (
        SELECT g, lvl, idx // 16 AS parent, list(digest ORDER BY idx) AS run FROM {name} WHERE n > 1 GROUP BY ALL
    )"""


def _walk(name: str, tree: str, start: str) -> str:
    """From ``start`` (k, g, idx, n, cur, sib) up to the top of a tree."""
    before, after = "array_to_string(run[1:w.idx % 16], '')", "array_to_string(run[w.idx % 16 + 2:], '')"
    return f"""
    {name} AS (
        SELECT k, g, 0 AS lvl, idx, n, cur, sib FROM {start}
        UNION ALL
        SELECT k, w.g, w.lvl + 1, w.idx // 16, (n + 15) // 16, sha256(concat({before}, cur, {after})), concat(sib, {before}, {after})
        FROM {name} w JOIN {tree}_runs r ON r.g = w.g AND r.lvl = w.lvl AND r.parent = w.idx // 16 WHERE n > 1
    )"""


def _leaf(text: str) -> str:
    parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)) END" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256(concat({', '.join(parts)}))"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MERKLE = f"""
    WITH RECURSIVE {CRC_TABLE}, d AS (
        SELECT doc_id, source, lang, n_chars, text,
               CASE WHEN doc_id IS NOT NULL AND {crc("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))")} % 5 = 0
                    THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS changed
        FROM documents, crc_table
    ), leaf AS (
        SELECT doc_id, source, {_leaf("text")} AS digest, {_leaf("changed")} AS other FROM d
    ), placed AS (
        SELECT *, row_number() OVER () AS k, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
        FROM leaf
    ), {_levels("low", "placed")}, subroots AS (
        SELECT 0 AS g, g AS idx, count(*) OVER () AS n, digest FROM low WHERE n = 1
    ), {_levels("high", "subroots")}, low_start AS (
        SELECT k, g, idx, n, other AS cur, '' AS sib FROM placed
    ), {_walk("low_walk", "low", "low_start")}, high_start AS (
        SELECT k, 0 AS g, w.g AS idx, (SELECT count(*) FROM subroots) AS n, cur, sib FROM low_walk w WHERE n = 1
    ), {_walk("high_walk", "high", "high_start")}
    SELECT doc_id, p.digest AS leaf, s.digest AS subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(sib) AS proof_sha256,
           cur AS folded_root, cur = (SELECT digest FROM high WHERE n = 1) AS verified
    FROM placed p JOIN subroots s ON s.idx = p.g JOIN high_walk h ON h.k = p.k AND h.n = 1
"""

#: UTF-8 bytes of a text whose characters are below U+0800.
_BYTES = """flatten(list_transform(string_split({}, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + unicode(c) // 64 AS BIGINT), CAST(128 + unicode(c) % 64 AS BIGINT)] END))"""

VARIANTS = f"""
    WITH RECURSIVE {CRC_TABLE}, tokens AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents
    ), counted AS (
        SELECT doc_id, run, count(*) AS n FROM tokens GROUP BY ALL
    ), hashed AS (
        SELECT run, n, {crc(_BYTES.format("concat(doc_id, ':', run)"))} AS h FROM counted, crc_table
    ), vocab AS (
        SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
        FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
    ), less AS (
        SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)
    ), pairs AS (
        SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
        UNION
        SELECT a.word, b.word, b.n FROM less a JOIN vocab b ON a.cut = b.word
        UNION
        SELECT b.word, a.word, a.n FROM less a JOIN vocab b ON a.cut = b.word
    ), best AS (
        SELECT word, count(*) AS n_near, arg_min(other, row(-other_n, other)) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
    ), forms AS (
        SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
        FROM vocab v LEFT JOIN best b ON b.word = v.word
    ), walk AS (
        SELECT word, word AS at FROM forms
        UNION ALL
        SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL
    )
    SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
    FROM forms f JOIN walk w ON w.word = f.word JOIN forms last ON last.word = w.at AND last.form IS NULL
"""
