"""SQL for DuckDB with the rows of those queries that SQL can express."""

from __future__ import annotations

from gateflow.llm.codes import CODES_SQL
from gateflow.llm.knn import KNN_SQL
from gateflow.llm.lexical import SEARCH_SQL

#: The windows by a recursive walk over the turns; lengths instead of texts.
CHAT_SQL = r"""
WITH RECURSIVE turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
    SELECT *, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
    FROM turns),
measured AS (
    SELECT *, place = 1 AND role = 'system' AS lead,
           len(regexp_extract_all(text,
               '[\p{L}\p{M}]+|\p{N}|[^\t\n\x0B\f\r \p{L}\p{M}\p{N}]')) + 4 AS tokens,
           25 + length(role) + length(text)
           + len(regexp_extract_all(role || chr(10) || text,
               '[<\[]\\*(\||/?s>|/?INST\]|<SYS>>|</SYS>>)')) AS chars
    FROM placed),
summed AS (
    SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id, lead ORDER BY place)
                   - tokens AS BIGINT) AS before
    FROM measured),
roomy AS (
    SELECT *, CAST(greatest(1, least(512, 2048 - tokens - coalesce(
        sum(tokens) FILTER (WHERE lead) OVER (PARTITION BY conv_id), 0))) AS BIGINT) AS room
    FROM summed),
reached AS (
    SELECT *, before - coalesce(min(before) OVER back, before) AS history,
           coalesce(sum(chars) OVER back, 0) AS history_chars
    FROM roomy
    WINDOW back AS (PARTITION BY conv_id, lead ORDER BY before
                    RANGE BETWEEN room PRECEDING AND 1 PRECEDING)),
said AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS n
    FROM reached WHERE NOT lead),
whole AS (
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place))
               AS turns_sha256,
           coalesce(string_agg(text, '' ORDER BY place)
                    FILTER (WHERE role = 'assistant'), '') AS targets,
           coalesce(sum(tokens) FILTER (WHERE lead), 0) AS base,
           coalesce(sum(chars) FILTER (WHERE lead), 0) AS base_chars,
           sum(chars) AS chars
    FROM reached GROUP BY conv_id),
walk AS (
    SELECT s.conv_id, s.n, w.base + s.tokens AS used, 0 AS repeated
    FROM said s JOIN whole w ON s.conv_id = w.conv_id WHERE s.n = 1
    UNION ALL
    SELECT s.conv_id, s.n,
           CASE WHEN k.used + s.tokens > 2048 THEN w.base + s.history + s.tokens
                ELSE k.used + s.tokens END,
           CASE WHEN k.used + s.tokens > 2048
                THEN w.base_chars + s.history_chars ELSE 0 END
    FROM walk k JOIN said s ON s.conv_id = k.conv_id AND s.n = k.n + 1
    JOIN whole w ON s.conv_id = w.conv_id),
again AS (SELECT conv_id, sum(repeated) AS repeated FROM walk GROUP BY conv_id)
SELECT w.conv_id, w.n_turns, w.turns_sha256, length(w.targets) AS loss_chars,
       sha256(w.targets) AS loss_sha256,
       CAST(w.chars + coalesce(a.repeated, 0) AS BIGINT) AS formatted_chars
FROM whole w LEFT JOIN again a ON w.conv_id = a.conv_id
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op1_chat_formatting": CHAT_SQL,
        "op4_knn_join": KNN_SQL,
        "op11_vector_codes": CODES_SQL,
        "op12_ranked_search": SEARCH_SQL,
    }
