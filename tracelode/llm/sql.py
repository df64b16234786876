"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP8 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
g AS (
  SELECT doc_id, body,
         first_value(doc_id) OVER w AS keep_id,
         row_number() OVER w AS r,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM t WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, r = 1 AS kept, sha256(body) AS text_sha256 FROM g
"""

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP9 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
         unnest([array_to_string(w[i:i + least(len(w), 13) - 1], ' ') FOR i IN range(1, greatest(len(w) - 12, 1) + 1)]) AS span
  FROM b WHERE len(w) > 0),
dw AS (
  SELECT doc_id, n, unnest([{{'s': i, 'span': array_to_string(w[i:i + n - 1], ' ')}} FOR i IN range(1, len(w) - n + 2)]) AS x
  FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
hits AS MATERIALIZED (
  SELECT doc_id, x.s AS s, dw.n AS n, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.span = x.span),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP4 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-1::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (
  SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<ROLE>>|<</ROLE>>|<<END>>'))
    + CASE role WHEN 'system' THEN 8 + 11 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 4 + 6 ELSE 18 + length(role) + 9 END AS n
  FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars,
  count(*) FILTER (NOT ((before = '' AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user') OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user'))) AS n_violations
FROM e GROUP BY conv_id
"""


def _op11(k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64) -> str:
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width} AND len(embedding) = {width})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, q, c, d FROM (
    SELECT v.*, c{i}.c, list_sum(list_transform(list_zip(v.q, c{i}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q
  FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(1, {width + 1})) AS i FROM a{i}) GROUP BY c, i) GROUP BY c
  UNION ALL SELECT c, q FROM c{i} WHERE c NOT IN (SELECT c FROM a{i}))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(f.q, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS f ON f.c = a.c"""


OP13 = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, doc_id,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM t),
m AS MATERIALIZED (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(c, b)),
o AS (
  SELECT x1.c || x2.c || x3.c || x4.c || x5.c AS filter_order, [x1.b, x2.b, x3.b, x4.b, x5.b] AS bits
  FROM x AS x1, x AS x2, x AS x3, x AS x4, x AS x5 WHERE x1.b | x2.b | x3.b | x4.b | x5.b = 31),
s AS (SELECT filter_order, i::INTEGER AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM o, range(1, 6) AS r(i)),
r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_format": OP4,
        "op8_exact_dedup": OP8,
        "op9_benchmark_decontamination": OP9,
        "op11_centroid_clustering": _op11(),
        "op13_filter_audit": OP13,
    }
