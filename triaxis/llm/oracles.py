"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

from .chat import CLOSE, HEAD, ROLES
from .queries import URL_RULES
from .url_filter import MAX_STRENGTH, MIN_STRENGTH, THRESHOLD, COUNTRY, NUMBERS, PORT, Z

LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SAID = "\\### Assistant: </turn> ok"


def chat() -> str:
    name = "CASE role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items()) + " ELSE '@' || replace(replace(replace(role, '\\', '\\\\'), ':', '\\c'), chr(10), '\\n') END"
    guard = r"(\\*)(###|</turn>)"
    body = f"regexp_replace(t, '{guard}', '\\\\\\1\\2', 'g')"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{SAID}' UNION ALL SELECT -7, 1, 'assistant', '{SAID}'),
 r AS (SELECT *, length('{HEAD}' || {name} || ':' || chr(10) || {body} || chr(10) || '{CLOSE}' || chr(10)) AS n, regexp_matches(t, '{guard}') AS escaped FROM c),
 g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '') AS loss, CAST(sum(n) AS BIGINT) AS formatted_chars, CAST(count(*) FILTER (escaped) AS BIGINT) AS n_escaped FROM r GROUP BY 1)
 SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_escaped FROM g"""


def decontamination() -> str:
    words = "regexp_extract_all(" + LOW.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH b AS (SELECT item_id, {words} AS w FROM benchmark), bw AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
 win AS (SELECT item_id, k, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS s FROM bw),
 d AS (SELECT doc_id, {words} AS w FROM documents), sizes AS (SELECT DISTINCT k FROM win),
 dw AS (SELECT doc_id, k, unnest(range(len(w) - k + 1)) AS p, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS s FROM d, sizes WHERE len(w) >= k),
 hit AS (SELECT doc_id, dw.k, p, item_id FROM dw JOIN win ON dw.k = win.k AND dw.s = win.s),
 n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY 1),
 i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
 SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""


def jaccard() -> str:
    words = "regexp_extract_all(" + LOW.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS x FROM d),
 e AS (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s),
 pr AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT u, v FROM pr WHERE 100 * c >= 80 * (nu + nv - c)),
 r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
 SELECT s.doc_id, len(x) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT u, min(v) AS c FROM r GROUP BY 1) m ON m.u = s.doc_id"""


def topk() -> str:
    return """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 q AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda t: t[1] * t[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM q) SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10"""


def url_filter() -> str:
    name = f"regexp_replace(host, '{PORT}', '')"
    last = lambda n: f"array_to_string(string_split({name}, '.')[-{n}:], '.')"
    tail = lambda n: f"CASE WHEN regexp_matches({name}, '{NUMBERS}') THEN {name} WHEN regexp_matches({name}, '{COUNTRY}') THEN {last(n + 2)} ELSE {last(n + 1)} END"
    rules = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r in sorted(URL_RULES, key=lambda r: (-len(r), r)))
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in URL_RULES.items()) + " END"
    spread, most = "sum(pow(x / n - m, 2))", "sum((1 - 1 / n) * m * (1 - m))"
    rho = f"(({spread}) - sum(m * (1 - m) / n)) / nullif({most}, 0)"
    k = f"CASE WHEN {most} IS NULL OR {most} <= 0 THEN {MIN_STRENGTH} WHEN {rho} <= 0 THEN {MAX_STRENGTH} ELSE greatest({MIN_STRENGTH}, least({MAX_STRENGTH}, 1 / nullif({rho}, 0) - 1)) END"
    return f"""WITH p AS (SELECT page_id, coalesce({LOW.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 o AS (SELECT *, CASE {rules} END AS rule FROM p), j AS (SELECT *, {verdict} AS own FROM o),
 h AS (SELECT host, CAST(count(own) AS DOUBLE) AS n, CAST(count(*) FILTER (own = 'block') AS DOUBLE) AS x, {tail(1)} AS domain, {tail(0)} AS suffix FROM j GROUP BY host),
 dm AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM h GROUP BY 1, 2), sf AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM dm GROUP BY 1),
 s1 AS (SELECT *, (SELECT (sum(x) + 1) / (sum(n) + 2) FROM sf) AS m FROM sf), sk AS (SELECT {k} AS k FROM s1 WHERE n > 0), s2 AS (SELECT suffix, (x + k * m) / (n + k) AS post FROM s1, sk),
 d1 AS (SELECT dm.*, post AS m FROM dm JOIN s2 USING (suffix)), dk AS (SELECT {k} AS k FROM d1 WHERE n > 0), d2 AS (SELECT domain, (x + k * m) / (n + k) AS post FROM d1, dk),
 h1 AS (SELECT h.*, post AS m FROM h JOIN d2 USING (domain)), hk AS (SELECT {k} AS k FROM h1 WHERE n > 0),
 ab AS (SELECT host, x + k * m AS a, n - x + k * (1 - m) AS b FROM h1, hk), bound AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM ab)
 SELECT page_id, host, path, rule, coalesce(own, CASE WHEN low > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict FROM j JOIN bound USING (host)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat(), "op3_decontamination": decontamination(), "op4_jaccard": jaccard(), "op5_topk": topk(), "op7_url_filter": url_filter()}
