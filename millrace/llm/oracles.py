"""SQL of the manifest and of spelling variants, in DuckDB's dialect."""

from __future__ import annotations

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(column: str) -> str:
    return f"translate({column}, '{_CAPITALS}', '{_SMALL}')"


def crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text of code points below U+0800, bit by bit: 8 steps a byte, the first of which takes the byte in."""
    letters = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END))"
    bits = f"flatten(list_transform({letters}, lambda b: CAST([b, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])))"
    step = "lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1))"
    return f"xor(list_reduce({bits}, {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"


_HEAD = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))

MERKLE = f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, source, {_HEAD} AS head, text, CAST(doc_id AS VARCHAR) AS name FROM documents),
    h AS (SELECT id, doc_id, source, sha256(head || {_field('text')}) AS leaf, CASE WHEN {crc32('name')} % 5 = 0 THEN sha256(head || {_field(low('text'))}) END AS other FROM d),
    l AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM h),
    u AS (SELECT g, 0 AS level, i, n, leaf AS digest FROM l UNION ALL
          SELECT g, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY g, level, i // 16, n),
    r AS (SELECT g, level AS height, digest AS subroot FROM u WHERE n = 1),
    t AS (SELECT 0 AS level, g AS i, (SELECT count(*) FROM r) AS n, subroot AS digest FROM r UNION ALL
          SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY level, i // 16, n),
    a AS (SELECT g, level, i, n, digest FROM u UNION ALL SELECT -1, level, i, n, digest FROM t),
    s AS MATERIALIZED (SELECT a.g, a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lft, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rgt
          FROM a JOIN a b ON a.g = b.g AND a.level = b.level AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY 1, 2, 3),
    p AS MATERIALIZED (SELECT l.id, s.level AS k, s.lft, s.rgt FROM l JOIN s ON s.g = l.g AND s.i = l.i >> (4 * s.level) UNION ALL
          SELECT l.id, r.height + s.level, s.lft, s.rgt FROM l JOIN r ON r.g = l.g JOIN s ON s.g = -1 AND s.i = l.g >> (4 * s.level)),
    f AS (SELECT id, 0 AS k, coalesce(other, leaf) AS digest FROM l UNION ALL SELECT f.id, f.k + 1, sha256(p.lft || f.digest || p.rgt) FROM f JOIN p ON p.id = f.id AND p.k = f.k),
    e AS (SELECT id, max_by(digest, k) AS folded_root FROM f GROUP BY id),
    q AS (SELECT id, sha256(string_agg(lft || rgt, '' ORDER BY k)) AS proof FROM p GROUP BY id)
    SELECT l.doc_id, l.leaf, r.subroot, t.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.digest AS verified
    FROM l JOIN r ON r.g = l.g JOIN e ON e.id = l.id JOIN t ON t.n = 1 LEFT JOIN q ON q.id = l.id"""

VARIANTS = f"""
    WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({low('text')}, '[a-z\u00C0-\u00FF]{{6,}}')) AS run FROM documents),
    c AS MATERIALIZED (SELECT run, n, {crc32("id || ':' || run")} AS h FROM (SELECT id, run, count(*) AS n FROM r GROUP BY 1, 2)),
    w AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM c),
    v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    i AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
    o AS MATERIALIZED (SELECT DISTINCT word, n, word[:i] || '_' || word[i + 2:] AS hole, word[:i] || word[i + 2:] AS less FROM i),
    p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM o a JOIN o b ON a.hole = b.hole AND a.word <> b.word
          UNION SELECT o.word, v.word, v.n FROM o JOIN v ON o.less = v.word UNION SELECT v.word, o.word, o.n FROM o JOIN v ON o.less = v.word),
    b AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM p),
    f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
          FROM v LEFT JOIN b ON b.word = v.word AND b.k = 1),
    t AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.up)
    SELECT f.word, f.form, t.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN t ON t.word = f.word AND t.up IS NULL"""
