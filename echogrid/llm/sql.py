"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import chat, mixing, quality, secrets

_WORDS = r"[^\x20\x09-\x0D]+"


def _count(chars: str, text: str = "l") -> str:
    return f"(length({text}) - length(translate({text}, '{chars}', '')))"


OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{_WORDS}') AS w FROM d),
wl AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i:i+4]) AS c FROM wl),
rep AS (SELECT r, count(DISTINCT i + k.k) AS n FROM g, range(5) AS k(k) WHERE c > 1 GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
ln AS (SELECT r, l, len(regexp_extract_all(l, '{_WORDS}')) AS n FROM lines),
lf AS (SELECT r, l, n,
  ({_count(quality.SEPARATORS)} >= 3 AND {_count(quality.SEPARATORS)} * 5 >= n)
  OR {_count(quality.SYMBOLS)} > n
  OR (length(l) - length(replace(l, '!!', '')) >= n AND length(l) - length(replace(l, '!!', '')) >= 4)
  OR (n >= 8 AND NOT regexp_matches(l, '{quality.SENTENCE_MARK}'))
  OR (n <= 25 AND regexp_matches(lower(l), '{quality.BOILERPLATE}')) AS fails
  FROM ln WHERE n > 0),
la AS (SELECT r, count(*) - count(DISTINCT l) AS dup, sum(length(l)) AS chars, sum(CASE WHEN fails THEN length(l) ELSE 0 END) AS lost FROM lf GROUP BY r),
f AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_count("#*$%&|<>", "t")} AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(chars, 0) AS chars, coalesce(lost, 0) AS lost
  FROM d JOIN w USING (r) LEFT JOIN la USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AND 100 * lost <= {quality.MAX_LOST_PERCENT} * chars AS kept
FROM f
"""


def _escaped(text: str) -> str:
    for plain, written in chat.ESCAPES:
        text = f"replace({text}, '{plain}', '{written}')"
    return text


OP4 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, sum(length({_escaped("role")}) + length({_escaped("text")}) + {len("<||>") + 1 + len(chat.END)}) OVER w AS upto,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""

_W = list(mixing.WEIGHTS)
_COMMON = 1
for _w in _W:
    _COMMON *= _w
OP6 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
a AS (SELECT source, source_size, row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1 AS i FROM s),
b AS (SELECT source, source_size, i, {_W}[(i % {len(_W)} + 1)::INT]::BIGINT AS w, source_size * {mixing.MAX_EPOCHS} AS cap FROM a),
c AS (SELECT *, cap * {_COMMON} / w AS r FROM b),
e AS (SELECT *, coalesce(sum(cap) OVER o, 0)::DOUBLE AS caps, (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS rest_w,
  (sum(source_size) OVER () * {mixing.BUDGET_PERCENT})::DOUBLE / 100 AS budget
  FROM c WINDOW o AS (ORDER BY r, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((budget - caps) / rest_w, (r, i)) AS level FROM e WHERE cap >= w * ((budget - caps) / rest_w)),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, w * level) END AS target FROM e, l),
f AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole FROM t),
m AS (SELECT d.*, f.source_size, f.target, f.whole, f.target - f.whole * f.source_size AS wanted,
  sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN middle < wanted THEN 1 ELSE 0 END))::BIGINT AS taken FROM m
"""

OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""



def _found(k: int) -> str:
    """Tables p and s of one kind: texts with their matches, then a row a match."""
    kind, pattern, group, least = secrets.KINDS[k]
    pattern = {"owned": "[A-Za-z0-9_-]{20,}"}.get(kind, secrets.SAME.get(kind, pattern)).replace("'", "''")
    return rf"""p{k} AS (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS b FROM d WHERE regexp_matches(t, '{pattern}')),
i{k} AS (SELECT r, unnest(range(1, len(m) + 1)) AS i, m, v, b FROM p{k}),
s{k} AS (SELECT r, {k} AS k, '{kind}' AS kind, (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, length(m[i]) AS n, v[i] AS v FROM i{k} WHERE length(v[i]) >= {least})"""


_LIVE = "(regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8 AND NOT regexp_matches(lower(v), 'example|changeme|placeholder|xxxx|1234567'))"
OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(doc_id::VARCHAR, '') AS repository, coalesce(text, '') AS t FROM documents),
{", ".join(_found(k) for k in range(len(secrets.KINDS)))},
base AS ({" UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(len(secrets.KINDS) - 1))}),
own AS (SELECT * FROM s{len(secrets.KINDS) - 1} s WHERE {_LIVE} AND (regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') OR regexp_matches(v, '[0-9].*[0-9].*[0-9].*[0-9]'))
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = s.r AND b.a < s.a + s.n AND s.a < b.a + b.n)),
f AS (SELECT * FROM base UNION ALL SELECT * FROM own),
held AS (SELECT v, count(DISTINCT repository) AS reps, count(DISTINCT owner) AS owners FROM f JOIN d USING (r) GROUP BY v),
j AS (SELECT r, k, kind, a, kind || ':' || a || ':' || (a + n) AS listed FROM f JOIN held USING (v)
  WHERE kind <> 'owned' OR NOT (owners >= {secrets.EXAMPLE_OWNERS} OR owners > 1 AND reps >= {secrets.EXAMPLE_REPOSITORIES}))
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (kind = '{x}') AS n_{x}" for x in ("assign", "access", "hex"))},
  sha256(coalesce(string_agg(listed, ',' ORDER BY a, k) FILTER (kind <> 'owned'), '')) AS base_sha256, coalesce(string_agg(listed, ',' ORDER BY a, k) FILTER (listed IS NOT NULL), '') AS spans
FROM d LEFT JOIN j USING (r) GROUP BY r
"""



def _rounds(n: int) -> str:
    """Tables a0, c1, a1, ...: assignments to the centroids of each round, and the centroids that follow."""
    out = []
    for r in range(n + 1):
        out.append(f"""p{r} AS (SELECT vec_id, v, c, w, list_inner_product(v, v) - 2 * list_inner_product(v, w) + list_inner_product(w, w) AS d FROM kept, c{r}),
a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min((d, c)) AS m FROM p{r} GROUP BY vec_id)""")
        if r < n:
            out.append(f"""u{r} AS (SELECT m[2] AS c, i, floor(sum(v[i]) / count(*)) AS y FROM a{r}, range(1, 65) AS t(i) GROUP BY m[2], i),
n{r} AS (SELECT c, list(y ORDER BY i) AS w FROM u{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN n{r} USING (c))""")
    return ",\n".join(out)


OP12 = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v AS w FROM kept QUALIFY c < 40),
{_rounds(5)},
f AS (SELECT vec_id, m[2]::INT AS cluster, m[1]::BIGINT AS distance FROM a5)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(w, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM f JOIN c5 ON c5.c = f.cluster
"""

SQL = {"op3_quality_rules": OP3, "op4_chat_formatting": OP4, "op6_source_mixing": OP6, "op7_exact_top_k": OP7, "op9_warc": OP9, "op10_secret_scan": OP10, "op12_centroid_clustering": OP12}
