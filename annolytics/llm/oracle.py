"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

import string

from annolytics.llm import chat_format as chat
from annolytics.llm.queries import PROBE_ID, PROBE_TEXT


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(column: str) -> str:
    sql = f"replace({column}, {_quoted(chat.MARK)}, {_quoted(chat.MARK + '0')})"
    for i, control in enumerate(chat.CONTROLS, start=1):
        sql = f"replace({sql}, {_quoted(control)}, {_quoted(f'{chat.MARK}{i}')})"
    return sql


_FRAME = len(chat.OPEN) + len(chat.BODY) + len(chat.CLOSE)

LLM_ORACLE = {
    "op1_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT {PROBE_ID}, 0, 'user', {_quoted(PROBE_TEXT)}
            UNION ALL SELECT {PROBE_ID}, 1, 'assistant', {_quoted(PROBE_TEXT)}
        ), marked AS (
            SELECT *, role IS DISTINCT FROM lag(role) OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS opens
            FROM turns
        )
        SELECT conv_id,
               count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
                   AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                   FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length({_escaped('text')}) + CASE WHEN opens THEN {_FRAME} + length({_escaped('role')})
                   ELSE {len(chat.NEXT)} END) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
    "op2_exact_dedup": f"""
        WITH digests AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}',
                   '{string.ascii_lowercase}')) AS text_sha256
            FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               text_sha256
        FROM digests WINDOW same AS (PARTITION BY text_sha256)
    """,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LLM_ORACLE["op12_filter_audit"] = rf"""
    WITH facts AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, {_WORDS} AS words FROM documents
    ), failing AS (
        SELECT doc_id, part,
               CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
               + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
               + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 4 ELSE 0 END
               + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
               + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS mask
        FROM facts
    ), marked AS (
        SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
        FROM failing LEFT JOIN (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
        ) USING (doc_id)
    ), grouped AS (
        SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
        FROM marked GROUP BY part, mask
    ), orders AS (
        SELECT [a.f, b.f, c.f, d.f, e.f] AS o
        FROM range(5) a(f), range(5) b(f), range(5) c(f), range(5) d(f), range(5) e(f)
        WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
    ), places AS (
        SELECT o, s.k AS step, o[s.k] AS f,
               (CASE WHEN s.k > 1 THEN 1 << o[1] ELSE 0 END) + (CASE WHEN s.k > 2 THEN 1 << o[2] ELSE 0 END)
               + (CASE WHEN s.k > 3 THEN 1 << o[3] ELSE 0 END) + (CASE WHEN s.k > 4 THEN 1 << o[4] ELSE 0 END) AS before
        FROM orders, range(1, 6) s(k)
    ), result AS (
        SELECT part, o, step, f,
               sum(CASE WHEN mask & (before | (1 << f)) = 0 THEN n ELSE 0 END) AS kept,
               sum(CASE WHEN mask & (1 << f) > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN mask & (1 << f) > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN mask = (1 << f) THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN mask & (1 << f) > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
               sum(CASE WHEN mask & (1 << f) > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
        FROM grouped, places GROUP BY part, o, step, f
    )
    SELECT part,
           substr('ABCDE', CAST(o[1] AS INT) + 1, 1) || substr('ABCDE', CAST(o[2] AS INT) + 1, 1)
           || substr('ABCDE', CAST(o[3] AS INT) + 1, 1) || substr('ABCDE', CAST(o[4] AS INT) + 1, 1)
           || substr('ABCDE', CAST(o[5] AS INT) + 1, 1) AS filter_order,
           CAST(step AS INT) AS step,
           CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
           CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM result
"""

_TERMS = rf"""regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

LLM_ORACLE["op11_ranked_search"] = f"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents
    ), sizes AS (
        SELECT r, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0
    ), corpus AS (
        SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes
    ), asked AS (
        SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
    ), counts AS (
        SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
        WHERE term IN (SELECT term FROM asked) GROUP BY r, term
    ), weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM counts, corpus GROUP BY term, docs
    ), impacts AS (
        SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) AS impact
        FROM counts JOIN weights USING (term) JOIN sizes USING (r), corpus
    ), scores AS (
        SELECT item_id, doc_id, r, CAST(sum(impact) AS BIGINT) AS score
        FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id, r
    ), ranked AS (
        SELECT item_id, doc_id, score,
               row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
        FROM scores WHERE score > 0
    )
    SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
