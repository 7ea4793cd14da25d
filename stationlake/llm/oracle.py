"""DuckDB SQL of the corpus queries that SQL can express in reasonable time.

The others (learned rules, tokenizer merges, page differencing, license
rules, fingerprints with their components) are tested against brute force.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op2_line_dedup"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT keyed.*, frequent.k IS NOT NULL AS gone FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

ORACLE["op3_exact_dedup"] = r"""
WITH docs AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
              FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM docs WINDOW g AS (PARTITION BY text_sha256)
"""

# CRC-32 by its rule: the table from the reversed polynomial, then one fold over the bytes.
ORACLE["op5_sharding"] = r"""
WITH RECURSIVE steps AS (
    SELECT b::BIGINT AS b, b::BIGINT AS v, 0 AS k FROM range(256) t(b)
    UNION ALL
    SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
bytes AS (SELECT doc_id, coalesce(text, '') AS s,
                 list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                lambda x: ('0x' || x)::BIGINT) AS l FROM documents),
sized AS (SELECT doc_id, strlen(s) + 8 AS size,
                 xor(list_reduce(list_prepend(4294967295::BIGINT, l),
                                 lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32
          FROM bytes, crc),
summed AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
                  sum(size) OVER () AS total FROM sized),
cut AS (SELECT *, ((2 * before + size) * 24 // (2 * total))::INT AS shard FROM summed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot,
       NULL::INT AS grown_shard
FROM cut
"""

# Base32: five hex digits are four letters.
ORACLE["op7_warc"] = r"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages),
digests AS (
    SELECT page_id, strlen(p)::BIGINT AS payload_bytes, upper(array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), ''))
        AS payload_digest
    FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = min(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER g THEN min(page_id) OVER g END AS refers_to
FROM digests WINDOW g AS (PARTITION BY payload_digest)
"""

# The dynamic programme: best(k, j) over the distinct lengths, earliest cut on ties.
ORACLE["op8_packing"] = r"""
WITH RECURSIVE counted AS (
    SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
parts AS (SELECT doc_id, n, unnest(range(greatest((n + 4095) // 4096, 1))) AS part FROM counted),
seqs AS (SELECT doc_id, part, part * 4096 AS start, least(n - part * 4096, 4096) AS n_tokens FROM parts),
stepped AS (SELECT *, greatest(n_tokens, 1) AS step FROM seqs),
hist AS (SELECT row_number() OVER (ORDER BY step) AS j, step, sum(count(*)) OVER (ORDER BY step) AS c,
                sum(sum(n_tokens)) OVER (ORDER BY step) AS t FROM stepped GROUP BY step),
ends AS (SELECT j, step, c, t FROM hist UNION ALL SELECT 0, 0, 0, 0),
best AS (
    SELECT 0 AS k, 0::BIGINT AS j, 0::HUGEINT AS pad, []::BIGINT[] AS bounds
    UNION ALL
    SELECT k, j, pad, bounds FROM (
        SELECT b.k + 1 AS k, e.j, (b.pad + e.step * (e.c - s.c) - (e.t - s.t))::HUGEINT AS pad,
               list_append(b.bounds, e.step::BIGINT) AS bounds,
               row_number() OVER (PARTITION BY e.j ORDER BY b.pad + e.step * (e.c - s.c) - (e.t - s.t), b.j) AS r
        FROM best b JOIN ends s ON s.j = b.j JOIN ends e ON e.j > b.j
        WHERE b.k < least(8, (SELECT max(j) FROM ends))) WHERE r = 1),
chosen AS (SELECT bounds FROM best WHERE j = (SELECT max(j) FROM ends) ORDER BY k DESC LIMIT 1),
placed AS (SELECT s.*, len(list_filter(bounds, lambda x: x < s.step)) AS bucket, bounds FROM stepped s, chosen),
numbered AS (SELECT *, bounds[bucket + 1] AS bucket_tokens,
                    row_number() OVER (PARTITION BY bucket ORDER BY step, doc_id, part) - 1 AS place FROM placed)
SELECT doc_id, part, start, n_tokens, bucket::INT AS bucket, bucket_tokens,
       place // (65536 // bucket_tokens) AS batch, place % (65536 // bucket_tokens) AS slot
FROM numbered
"""

# The level in closed form: sources by cap / weight; the first that stays under its cap sets it.
ORACLE["op11_mixing"] = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5(concat_ws(':', '11', doc_id)) AS place FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS cap,
           [5.0::DOUBLE, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM sized GROUP BY source),
filled AS (
    SELECT *, row_number() OVER o AS r,
           (1.5::DOUBLE * sum(source_size) OVER ()
            - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM sources WINDOW o AS (ORDER BY cap / weight, source)),
water AS (SELECT arg_min(level, r) AS level FROM filled WHERE level * weight <= cap),
targets AS (SELECT source, source_size, least(cap, water.level * weight) AS target,
                   CASE WHEN source_size > 0 THEN floor(least(cap, water.level * weight) / source_size) ELSE 0 END AS whole
            FROM sources, water),
placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, t.whole,
           floor(t.target - t.whole * t.source_size + 0.5)
           - (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size) AS room
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (whole * size + greatest(least(room, size), 0))::BIGINT AS taken
FROM placed
"""

_CRC_TABLE = """steps AS (
    SELECT b::BIGINT AS b, b::BIGINT AS v, 0 AS k FROM range(256) t(b)
    UNION ALL
    SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8)"""

# Nodes are the distinct prefixes; a node counts for every prefix of its own smallest member.
ORACLE["op12_conversation_trie"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
turns AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
                 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
          FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'id': id, 'words': words}} ORDER BY turn NULLS FIRST, id) AS ts FROM turns GROUP BY conv_id),
cut AS (SELECT own.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                   string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                   lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 4 AS h FROM own, crc),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts
            FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
prefixes AS (SELECT conv_id, d, len(ts) AS n, md5(array_to_string(list_transform(ts[1:d], lambda x: x.id), '')) AS k,
                    CASE WHEN d > 0 THEN ts[d].words ELSE 0 END AS words
             FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
          FROM prefixes GROUP BY d, k),
linked AS (SELECT v.*, p.k AS parent, u.conv_id AS parent_conv_id
           FROM nodes v LEFT JOIN prefixes p ON p.conv_id = v.conv_id AND p.d = v.d - 1
           LEFT JOIN nodes u ON u.d = p.d AND u.k = p.k),
fans AS (SELECT d - 1 AS d, parent AS k, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL),
whole AS (SELECT v.*, coalesce(f.n_children, 0) AS n_children FROM linked v LEFT JOIN fans f ON f.d = v.d AND f.k = v.k),
sums AS (SELECT p.d, p.k, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves,
                sum((v.n_convs - 1) * v.words) AS saved_tokens
         FROM whole v JOIN prefixes p ON p.conv_id = v.conv_id AND p.d <= v.d GROUP BY p.d, p.k)
SELECT w.conv_id, w.d::BIGINT AS depth, w.parent_conv_id, w.n_convs, w.n_children, s.n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w JOIN sums s ON s.d = w.d AND s.k = w.k
"""


def _lloyd(rounds: int) -> str:
    """Each round as two tables: the nearest entries, and the moved codebooks."""
    def assign(n: int) -> str:
        return f"""dist{n} AS MATERIALIZED (
    SELECT p.row_id, p.part, b.entry,
           list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts p JOIN book{n} b ON b.part = p.part),
near{n} AS MATERIALIZED (
    SELECT row_id, part, (min(d * 256 + entry) % 256)::INT AS entry, min(d) AS d FROM dist{n} GROUP BY row_id, part)"""

    def move(n: int) -> str:
        return f"""mean{n} AS (
    SELECT part, entry, list(m ORDER BY j) AS v FROM (
        SELECT part, entry, j, (sum(x)::BIGINT - ((sum(x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS m
        FROM (SELECT n.part, n.entry, unnest(p.v) AS x, unnest(range(len(p.v))) AS j
              FROM near{n} n JOIN parts p ON p.row_id = n.row_id AND p.part = n.part)
        GROUP BY part, entry, j) GROUP BY part, entry),
book{n + 1} AS MATERIALIZED (
    SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN mean{n} m ON m.part = b.part AND m.entry = b.entry)"""

    return ",\n".join(assign(n) + (",\n" + move(n) if n < rounds else "") for n in range(rounds + 1))


ORACLE["op13_vector_codes"] = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS row_id, vec_id, label,
           list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS ints
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
    SELECT row_id, part, ints[part * (len(ints) // 8) + 1 : (part + 1) * (len(ints) // 8)] AS v
    FROM (SELECT *, unnest(range(8)) AS part FROM kept)),
book0 AS MATERIALIZED (SELECT part, row_id - 1 AS entry, v FROM parts WHERE row_id <= 16),
{_lloyd(6)},
codes AS (SELECT row_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
          FROM near6 GROUP BY row_id),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book6)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN codes USING (row_id), books
"""
