"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

#: The 256 checksum steps of CRC-32, and the checksum of a list of bytes.
_CRC_TABLE = """crc_table AS (
        SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b::BIGINT) ORDER BY b) AS t
        FROM (SELECT unnest(range(0, 256)) AS b)
    )"""


def _crc32(codes: str) -> str:
    return f"xor(4294967295, list_reduce({codes}, lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256), 4294967295))"


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}, '-')"

EXACT = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: Levels of both trees one recursion step at a time; each row climbs beside them with what stands beside it.
MERKLE = f"""
    WITH RECURSIVE {_CRC_TABLE},
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS rid
        FROM (
            SELECT doc_id, lang, sha256(a || {_FIELD.format("n_chars")} || z) AS leaf, sha256(a || {_FIELD.format("(n_chars + bad)")} || z) AS copy
            FROM (
                SELECT doc_id, lang, n_chars, {_FIELD.format("doc_id")} || {_FIELD.format("source")} || {_FIELD.format("lang")} AS a, {_FIELD.format("text")} AS z,
                       ({_crc32("list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)")} % 7 = 0)::BIGINT AS bad
                FROM documents, crc_table
            )
        )
    ),
    nodes AS (
        SELECT lang, 0 AS height, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM placed
        UNION ALL
        SELECT lang, height + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, height, n, pos // 2
    ),
    subroots AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM nodes WHERE n = 1),
    tops AS (
        SELECT 0 AS height, place AS pos, subroot AS node, count(*) OVER () AS n FROM subroots
        UNION ALL
        SELECT height + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY height, n, pos // 2
    ),
    climb AS (
        SELECT rid, lang, 0 AS height, pos, copy AS acc, '' AS beside FROM placed
        UNION ALL
        SELECT c.rid, c.lang, c.height + 1, c.pos // 2,
               CASE WHEN c.pos % 2 = 1 THEN sha256(s.node || c.acc) ELSE sha256(c.acc || coalesce(s.node, '')) END, c.beside || coalesce(s.node, '')
        FROM climb c
        JOIN nodes o ON o.lang IS NOT DISTINCT FROM c.lang AND o.height = c.height AND o.pos = c.pos AND o.n > 1
        LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.height = c.height AND s.pos = xor(c.pos, 1)
    ),
    last AS (
        SELECT c.rid, s.subroot, 0 AS height, s.place AS pos, c.acc, c.beside
        FROM climb c
        JOIN nodes o ON o.lang IS NOT DISTINCT FROM c.lang AND o.height = c.height AND o.n = 1
        JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang
        UNION ALL
        SELECT c.rid, c.subroot, c.height + 1, c.pos // 2,
               CASE WHEN c.pos % 2 = 1 THEN sha256(s.node || c.acc) ELSE sha256(c.acc || coalesce(s.node, '')) END, c.beside || coalesce(s.node, '')
        FROM last c
        JOIN tops o ON o.height = c.height AND o.pos = c.pos AND o.n > 1
        LEFT JOIN tops s ON s.height = c.height AND s.pos = xor(c.pos, 1)
    )
    SELECT p.doc_id, p.leaf, l.subroot, r.node AS root, sha256(l.beside) AS proof_sha256, l.acc AS folded_root, l.acc = r.node AS verified
    FROM placed p JOIN last l USING (rid) JOIN tops r ON r.n = 1 AND l.height = r.height
"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_FEATURES = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_BYTES = "list_transform(range(1, len(hex(encode(f))) + 1, 2), lambda i: 16 * (strpos('0123456789ABCDEF', hex(encode(f))[i]) - 1) + strpos('0123456789ABCDEF', hex(encode(f))[i + 1]) - 1)"

RESAMPLING = f"""
    WITH {_CRC_TABLE},
    docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
    items AS (SELECT coalesce({_WORDS}, []) AS w FROM benchmark),
    here AS (SELECT rid, unnest({_FEATURES}) AS f FROM docs),
    there AS (SELECT unnest({_FEATURES}) AS f FROM items),
    coded AS (SELECT f, {_crc32(_BYTES)} % 10000 AS bucket FROM (SELECT f FROM here UNION SELECT f FROM there), crc_table),
    s AS (SELECT bucket, count(*) AS s FROM here JOIN coded USING (f) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM there JOIN coded USING (f) GROUP BY bucket),
    sums AS (SELECT (SELECT count(*) FROM here)::DOUBLE AS sa, (SELECT count(*) FROM there)::DOUBLE AS ta),
    gain AS (
        SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sa + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (ta + 10000))))::BIGINT AS g
        FROM (SELECT unnest(range(0, 10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums
    ),
    weights AS (SELECT rid, count(*) AS n, sum(g)::BIGINT AS g FROM here JOIN coded USING (f) JOIN gain USING (bucket) GROUP BY rid),
    scored AS (
        SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
               floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
        FROM docs LEFT JOIN weights USING (rid)
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY weight + noise DESC, doc_id) AS place, count(*) FILTER (words >= 20) OVER () * 25 // 100 AS drawn
        FROM scored
    )
    SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN words >= 20 AND place <= drawn THEN place END AS rank FROM ranked
"""
