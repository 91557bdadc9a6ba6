"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
    FROM w
), n AS (
    SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY 1, 2
), l AS (
    SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), e AS (
    SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(node, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.other
), c AS (
    SELECT node, min(other) AS component_id FROM r GROUP BY 1
)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN c ON c.node = n.doc_id
"""

DECONTAMINATION = f"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
), v AS (
    SELECT DISTINCT item, least(10, len(ws)) AS size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
    FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (
    SELECT DISTINCT size FROM v
), g AS (
    SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS g
    FROM (SELECT doc_id, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)
), h AS (
    SELECT doc_id, item, g.size, i FROM g JOIN v ON g.size = v.size AND g.g = v.g
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY 1
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

PREFIX_TRIE = """
WITH RECURSIVE t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
        list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
            lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END))) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
    SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY part, place) AS place, role, text FROM (
        SELECT c.conv_id, 0 AS part, place, role, text FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
        UNION ALL
        SELECT c.conv_id, 1, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h
    ) c
), n(conv_id, place, name, chars) AS (
    SELECT conv_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT) FROM c
    UNION ALL
    SELECT r.conv_id, r.place, sha256(n.name || ':' || length(r.role) || ':' || r.role || r.text), length(r.text)
    FROM n JOIN r ON r.conv_id = n.conv_id AND r.place = n.place + 1
), m AS (
    SELECT place, name, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM n GROUP BY 1, 2
), e AS (
    SELECT n.conv_id, n.place, m.conv_id AS node FROM n JOIN m ON m.place = n.place AND m.name = n.name
), k AS (
    SELECT m.conv_id, m.place, p.node AS parent FROM m LEFT JOIN e p ON p.conv_id = m.conv_id AND p.place = m.place - 1
), kids AS (
    SELECT parent AS conv_id, place - 1 AS place, count(*) AS n_children FROM k WHERE place > 0 GROUP BY 1, 2
), v AS (
    SELECT m.conv_id, m.place, k.parent, n_convs, coalesce(n_children, 0) AS n_children, (n_convs - 1) * chars AS saved
    FROM m JOIN k USING (conv_id, place) LEFT JOIN kids USING (conv_id, place)
), s AS (
    SELECT e.node AS conv_id, e.place, sum(CAST(v.n_children = 0 AS BIGINT)) AS n_leaves, sum(v.saved) AS saved_tokens
    FROM v JOIN e ON e.conv_id = v.conv_id AND e.place <= v.place GROUP BY 1, 2
), f AS (
    SELECT node AS conv_id, place, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends
    FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.conv_id = e.conv_id AND x.place = e.place + 1) GROUP BY 1, 2
)
SELECT v.conv_id, v.place AS depth, v.parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
    CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM v JOIN s USING (conv_id, place) LEFT JOIN f USING (conv_id, place)
"""

COLLOCATIONS = f"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p
), g AS (
    SELECT lang, size, ws[i:i + size - 1] AS g, count(*) AS f
    FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS size))
    GROUP BY 1, 2, 3
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY 1
), c AS (
    SELECT * FROM g WHERE size > 1 AND f >= 10
), around AS (
    SELECT lang, g, max(f) AS f FROM (
        SELECT lang, g[1:2] AS g, f FROM c WHERE size = 3 UNION ALL SELECT lang, g[2:3], f FROM c WHERE size = 3
    ) GROUP BY 1, 2
), kept AS (
    SELECT c.* FROM c LEFT JOIN around a ON a.lang = c.lang AND a.g = c.g AND c.size = 2
    WHERE a.f IS NULL OR 100 * a.f < 50 * c.f
), cuts AS (
    SELECT kept.lang, kept.g, kept.f AS a, k, l.f AS l, r.f AS r,
        CAST(1000000 AS HUGEINT) * kept.f * kept.f // (CAST(l.f AS HUGEINT) * r.f) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM kept) kept
    JOIN g l ON l.lang = kept.lang AND l.g = kept.g[1:k] JOIN g r ON r.lang = kept.lang AND r.g = kept.g[k + 1:]
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), ranked AS (
    SELECT *, array_to_string(g, ' ') AS phrase,
        row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

REPEATED_SPANS = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
    SELECT doc_id, 256 * b AS base, substring(h, CAST(512 * b + 1 AS BIGINT), 710) AS part
    FROM (SELECT doc_id, h, unnest(range(0, length(h) // 512 + 1)) AS b FROM d)
), g AS (
    SELECT doc_id, base + i AS i, md5(substring(part, CAST(2 * i + 1 AS BIGINT), 200)) AS s
    FROM (SELECT doc_id, base, part, unnest(range(0, least(length(part) // 2 - 99, 256))) AS i FROM blocks)
), later AS (
    SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
), marked AS (
    SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, TRUE) AS new FROM later
), runs AS (
    SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
        SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
    ) GROUP BY doc_id, run
), cut AS (
    SELECT r.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
        string_agg(substring(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept, max(b) AS last
    FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs) r JOIN d ON d.doc_id = r.doc_id
    GROUP BY 1
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(kept, '') || substring(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""

ORACLES = {
    "op3_decontaminate": DECONTAMINATION,
    "op9_near_duplicates": NEAR_DUPLICATES,
    "op11_prefix_trie": PREFIX_TRIE,
    "op12_collocations": COLLOCATIONS,
    "op13_repeated_spans": REPEATED_SPANS,
}
