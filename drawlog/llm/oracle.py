"""Check SQL (DuckDB) of the registered queries that SQL can express, over whole tables."""

from __future__ import annotations

from drawlog.llm.pii import BASE
from drawlog.llm.urls import STATED, UNWANTED

#: The patterns as an engine reads them that never steps back and has no look-around.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}


def _pii() -> str:
    kinds = " UNION ALL ".join(
        f"SELECT n, {rank} AS kind_rank, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d" for rank, (kind, p) in enumerate(_PATTERNS.items())
    )
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
    k AS ({kinds}),
    e AS (SELECT n, kind_rank, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
    p AS (
      SELECT n, kind_rank, kind, m[i] AS x, regexp_replace(m[i], '[^0-9]', '', 'g') AS digits,
             coalesce(list_sum([length(z) for z in g[1:i]]), 0)::BIGINT + coalesce(list_sum([length(z) for z in m[1:i - 1]]), 0)::BIGINT AS s,
             right(g[i], 40) || ' ' || left(g[i + 1], 40) AS near
      FROM e),
    c AS (
      SELECT n, kind_rank, kind, s, s + length(x) AS z FROM p WHERE CASE kind
        WHEN 'email' THEN true
        WHEN 'ip' THEN list_bool_and([v::HUGEINT <= 255 for v in string_split(x, '.')])
        WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum([
          CASE WHEN j % 2 = 0 THEN 2 * substr(reverse(digits), j, 1)::INT - CASE WHEN substr(reverse(digits), j, 1)::INT > 4 THEN 9 ELSE 0 END
          ELSE substr(reverse(digits), j, 1)::INT END for j in range(1, length(digits) + 1)]) % 10 = 0
        WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
        WHEN 'iban' THEN length(replace(x, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, [
          CASE WHEN y BETWEEN '0' AND '9' THEN ascii(y) - 48 ELSE ascii(y) - 55 END::BIGINT
          for y in string_split(substr(replace(x, ' ', ''), 5) || left(replace(x, ' ', ''), 4), '')]),
          lambda a, b: CASE WHEN b > 9 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1
        ELSE NOT regexp_matches(x, '^(?:000|666|9)|-00-|-0000$') AND regexp_matches(near, '(?i)\\b(ssn|social security|tax id)\\b') END),
    a AS (
      SELECT n, {counts},
             string_agg(kind || ':' || s || ':' || z, ',' ORDER BY s, kind_rank) FILTER (kind IN ({base})) AS base,
             string_agg(kind || ':' || s || ':' || z, ',' ORDER BY s, kind_rank) AS spans
      FROM c GROUP BY n)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (n)"""


def _urls() -> str:
    rules = ", ".join(f"('{v}', '{n}', '{n.partition('/')[0]}', '/{n.partition('/')[2]}')" for v, n in STATED)
    words = "|".join(UNWANTED)
    return f"""
    WITH u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r AS (SELECT * FROM (VALUES {rules}) AS x(verdict, rule, h, p)),
    f AS (SELECT n, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
          FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
    SELECT page_id, host, path, rule,
           coalesce(verdict, CASE WHEN regexp_matches(host || path, '^(?:[^/]*[.-])?(?:{words})(?:[.-][^/]*)?(?:/|$)') THEN 'block' ELSE 'allow' END) AS verdict
    FROM p LEFT JOIN f USING (n)"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_DECONTAMINATION = f"""
    WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    bs AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bs)),
    ks AS (SELECT DISTINCT k FROM bw),
    dw AS (SELECT n, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
           FROM (SELECT n, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
    m AS (SELECT DISTINCT n, dw.k AS k, i, item_id FROM dw JOIN bw USING (k, win)),
    hits AS (SELECT n, count(DISTINCT pos) AS n_hit FROM (SELECT n, unnest(range(i, i + k)) AS pos FROM m) GROUP BY n),
    items AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT n, item_id::VARCHAR AS item FROM m) GROUP BY n)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hits USING (n) LEFT JOIN items USING (n)"""

#: The standard template writes "### Role: text </turn>" and a line end, with a backslash before "\", "#" of "###" and "<" of "</turn>".
_CHAT = """
    WITH c AS (
      SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
      UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
    e AS (
      SELECT *, length(text) + length(regexp_replace(text, '[^\\\\]', '', 'g'))
               + coalesce(list_sum([length(x) - 2 for x in regexp_extract_all(text, '#{3,}')]), 0)
               + len(regexp_extract_all(text, '</turn>')) + length(role) + length('### : ') + length(' </turn>') + 1 AS size
      FROM c)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(size)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id"""

_TOPK = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, max(list_inner_product(q.w, v.w))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 5"""

ORACLE = {"op1_pii": _pii(), "op2_url_filters": _urls(), "op6_decontamination": _DECONTAMINATION, "op10_chat": _CHAT, "op12_topk": _TOPK}
