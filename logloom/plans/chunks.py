"""DuckDB SQL of content-defined chunking, so that chunk queries have a value oracle.

The low bits of the rolling hash depend on the last few bytes alone, so all candidates for a cut are known at once; the
chunks are then a walk from cut to cut: the first candidate far enough on, else the longest chunk, else the end.
"""

from __future__ import annotations

from logloom.functions.cdc import GEAR, Bounds

#: Records of conversations as ``conversation_records`` writes them.
ESCAPED = """'"' || replace(replace(replace({0}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"'"""
CONVERSATION = """talk AS (SELECT conv_id AS session_id, turn::BIGINT AS rec_idx, role, '{{"type":"response_item","timestamp":"2026-01-01T00:' || lpad((turn % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((turn % 60)::VARCHAR, 2, '0')
    || 'Z","payload":{{"type":"message","role":' || {role} || ',"text":' || {text} || '}}}}' || chr(10) AS record FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    whole AS (SELECT session_id, string_agg(record, '' ORDER BY rec_idx) AS data FROM talk GROUP BY session_id)""".format(role=ESCAPED.format("coalesce(role, '')"), text=ESCAPED.format("coalesce(text, '')"))


def cdc(source: str, bounds: Bounds) -> str:
    """CTEs that end in ``cdc`` (session_id, digest, size) over ``source`` (session_id, data); needs WITH RECURSIVE."""
    bits = bounds.average.bit_length() - 1
    low = [int(x) & (bounds.average - 1) for x in GEAR]
    sums = " + ".join(f"coalesce(lag(t, {j}) OVER w, 0) * {1 << j}" for j in range(bits))
    return f"""src AS MATERIALIZED (SELECT session_id, encode(data) AS e, octet_length(encode(data)) AS n FROM {source} WHERE data <> ''),
    bytes AS (SELECT session_id, i, ({low})[('0x' || hex(e[i:i]))::INT + 1] AS t FROM (SELECT session_id, e, unnest(range(1, n + 1)) AS i FROM src)),
    rolled AS (SELECT session_id, i, {sums} AS g FROM bytes WINDOW w AS (PARTITION BY session_id ORDER BY i)),
    candidates AS MATERIALIZED (SELECT session_id, list(i ORDER BY i) AS at FROM rolled WHERE g % {bounds.average} = 0 GROUP BY session_id),
    cuts AS (SELECT session_id, 0::BIGINT AS start, 0::BIGINT AS stop FROM src
        UNION ALL SELECT c.session_id, c.stop, least(coalesce(list_filter(a.at, lambda x: x >= c.stop + {bounds.least})[1], s.n), c.stop + {bounds.most}, s.n)::BIGINT
        FROM cuts c JOIN src s ON s.session_id = c.session_id LEFT JOIN candidates a ON a.session_id = c.session_id WHERE c.stop < s.n),
    cdc AS (SELECT session_id, sha256(e[start + 1:stop]) AS digest, stop - start AS size FROM cuts JOIN src USING (session_id) WHERE stop > start)"""
