"""DuckDB SQL for the subpackage's queries that SQL can express."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op10_chat_formatting"] = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *,
        replace(replace(replace(replace(replace(replace(replace(replace(text,
            '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS esc,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role
            AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT NULL AS goes_on
    FROM t
)
SELECT conv_id,
    count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
    sum(length(esc) + CASE WHEN goes_on THEN 8 ELSE 8 + length(role) + 1 + 8 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE_SQL["op3_source_mixing"] = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS shuffled,
        row_number() OVER () AS key FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
    SELECT *, CASE place % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 2 AS most FROM s
), f AS (
    SELECT *, most / weight AS fills_at FROM w
), l AS (
    SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(most) OVER (ORDER BY fills_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(weight) OVER (ORDER BY fills_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f
), t AS (
    SELECT source, source_size, place, coalesce(least(weight * (SELECT min_by(level, struct_pack(fills_at, place)) FROM l WHERE level <= fills_at), most), most)::DOUBLE AS target FROM l
), o AS (
    SELECT doc_id, size, source_size, target, place, shuffled, key, greatest(1, least(1000, floor(target / 500)))::BIGINT AS packet,
        sum(size) OVER (PARTITION BY place ORDER BY shuffled, size, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
    SELECT key, place, source_size, target, size, packet, start + copy * source_size AS start, unnest(generate_series(0, size - 1, packet)) AS skip
    FROM o, (VALUES (0), (1)) c(copy) WHERE size > 0
), e AS (
    SELECT key, place, target, least(packet, size - skip) AS words, start + skip + least(packet, size - skip) AS finish_words FROM q
), g AS (
    SELECT key, words, sum(words) OVER (ORDER BY finish_words::DOUBLE / target, place, finish_words ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS mix_offset FROM e
), k AS (
    SELECT key, sum(greatest(0, least(words, (SELECT floor(sum(size) * 1.5) FROM d) - mix_offset)))::BIGINT AS taken FROM g GROUP BY key
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM o LEFT JOIN k USING (key)
"""

ORACLE_SQL["op5_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""

ORACLE_SQL["op7_line_dedup"] = r"""
WITH d AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
    SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""
