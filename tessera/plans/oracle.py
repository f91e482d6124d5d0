"""SQL for DuckDB of the core's queries, written from their definitions.

Queries without SQL here are tested against brute force, another engine or an exact round trip: stemmed
search and phrases against SQLite's index, HTML by fixtures, resampling by tolerance, first-fit clusters
and random draws by their properties.
"""

from __future__ import annotations

from ..functions.text import STOPWORDS, STUB_PHRASES
from ..operators import prompts

_RUNS = """
runs AS (
  SELECT system, query_id, row_number() OVER (PARTITION BY system, query_id ORDER BY k, chunk_id)::INT AS rank, chunk_id FROM (
    SELECT r.system, r.query_id, r.chunk_id, min(CASE WHEN s.higher_is_better THEN -r.score ELSE r.score END) AS k
    FROM rankings r JOIN systems s ON r.system = s.system WHERE r.score IS NOT NULL AND r.chunk_id IS NOT NULL GROUP BY ALL))"""
_PAGES = """
known AS (SELECT url, max(CASE WHEN canonical_url <> '' THEN canonical_url END) AS canonical, min(coalesce(status, 'ok')) AS status FROM pages WHERE url IS NOT NULL GROUP BY url),
pm AS (SELECT i.chunk_id, i.url, coalesce(k.canonical, i.url) AS page, coalesce(k.status, 'ok') AS status
  FROM (SELECT chunk_id, min(url) AS url FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id) i LEFT JOIN known k ON i.url = k.url)"""
_QRELS = "qrels AS (SELECT f.query_id, pm.page AS unit, max(CASE WHEN best_rank <= 3 THEN 2 ELSE 1 END) AS grade FROM fused f JOIN pm USING (chunk_id) GROUP BY ALL)"
_ASKED = r"asked AS (SELECT DISTINCT query_id, ['api_lookup', 'conceptual', 'multi_hop', 'tutorial'][regexp_extract(query_id, '(\d+)$', 1)::INT % 4 + 1] AS category FROM rankings WHERE query_id IS NOT NULL)"
_UNITS = """
units AS (SELECT system, query_id, row_number() OVER (PARTITION BY system, query_id ORDER BY r, unit)::INT AS rank, unit FROM (
  SELECT system, query_id, page AS unit, min(rank) AS r FROM runs JOIN pm USING (chunk_id) GROUP BY ALL))"""
_EVAL = f"WITH {_RUNS}, {_PAGES}, {_QRELS}, {_ASKED}, {_UNITS}"
_SCORES = f"""{_EVAL},
judged AS (SELECT query_id, count(*) AS judged, count(*) FILTER (grade > 0) AS n_relevant FROM qrels GROUP BY query_id),
ideal AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, unit) AS r FROM qrels WHERE grade > 0) WHERE r <= 10 GROUP BY query_id),
found AS (SELECT system, query_id, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, min(rank) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10) AS dcg
  FROM units JOIN qrels USING (query_id, unit) WHERE grade > 0 GROUP BY ALL),
scores AS (SELECT s.system, a.query_id, a.category, j.judged, j.n_relevant, coalesce(h5 / n_relevant::DOUBLE, 0) AS recall_5, coalesce(h10 / n_relevant::DOUBLE, 0) AS recall_10, coalesce(1.0::DOUBLE / first, 0) AS mrr,
    coalesce(dcg / ideal, 0) AS ndcg_10, least(5, n_relevant) / n_relevant::DOUBLE AS ceiling_5, least(10, n_relevant) / n_relevant::DOUBLE AS ceiling_10
  FROM asked a JOIN judged j USING (query_id) CROSS JOIN (SELECT DISTINCT system FROM runs) s LEFT JOIN found f ON f.system = s.system AND f.query_id = a.query_id LEFT JOIN ideal i ON i.query_id = a.query_id)"""
_POOL = f"""{_EVAL},
top AS (SELECT r.*, pm.page, list_position(['bm25', 'dense', 'rerank', 'agent', 'distance'], system) - 1 AS o FROM runs r JOIN pm USING (chunk_id) WHERE rank <= 10),
pooled AS (SELECT query_id, page AS url, arg_min(chunk_id, o * 1000 + rank) AS chunk_id, string_agg(system || '@' || rank, ', ' ORDER BY o, rank) AS found_by FROM top GROUP BY ALL),
judged AS (SELECT DISTINCT q.query_id, coalesce(p.page, q.unit) AS url FROM qrels q LEFT JOIN (SELECT DISTINCT url, page FROM pm) p ON p.url = q.unit),
details AS (SELECT chunk_id, max({{'text': coalesce(text, ''), 'title': title, 'heading_path': heading_path}}) AS d FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"""
_FIRSTS = "firsts AS (SELECT * FROM (SELECT r.*, pm.page, list_position(['bm25', 'dense', 'rerank', 'agent', 'distance'], system) - 1 AS o, row_number() OVER (PARTITION BY system, query_id, page ORDER BY rank, r.chunk_id) AS n FROM runs r JOIN pm USING (chunk_id) WHERE rank <= {depth}) WHERE n = 1)"


def _fuse(depth: int, compact: bool) -> str:
    used = "row_number() OVER (PARTITION BY system, query_id ORDER BY rank, chunk_id)" if compact else "rank"
    return f"""WITH {_RUNS}, {_PAGES}, {_FIRSTS.format(depth=depth)},
placed AS (SELECT *, {used} AS used FROM firsts),
f AS (SELECT query_id, page, round(sum(1e0 / (60 + used)), 12) AS score, min(rank) AS best_rank, arg_min(chunk_id, rank * 10 + o) AS chunk_id FROM placed GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, page)::INT AS r FROM f)"""


_SP = r"'[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"
_CHUNKS = "c AS (SELECT DISTINCT ON (chunk_id, url, ordinal, text) * FROM chunks)"
_DOTTED = r"'\b(?:[A-Za-z_][A-Za-z0-9_]*\.)+([A-Za-z_][A-Za-z0-9_]*)\b', '\1', 'g'"
_BASE = r"regexp_replace(regexp_replace(list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1), '\.html$', ''), '_class$', '')"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_TITLES = "q AS (SELECT DISTINCT title AS query FROM pages WHERE title IS NOT NULL)"
_WORDS = rf"""
raw AS (SELECT query, unnest(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_.]*|\d+')) AS t, generate_subscripts(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_.]*|\d+'), 1) AS i FROM q),
low AS (SELECT query, i, lower(regexp_replace(t, '^\.+|\.+$', '', 'g')) AS t FROM raw),
ok AS (SELECT * FROM low WHERE t <> '' AND NOT list_contains({_STOP}, t)),
parts AS (SELECT query, i, 0 AS j, t FROM ok UNION ALL
  SELECT query, i, generate_subscripts(string_split(t, '.'), 1) AS j, unnest(string_split(t, '.')) AS t FROM ok WHERE contains(t, '.')),
terms AS (SELECT query, t, min(i * 1000 + j) AS spot FROM parts WHERE t <> '' AND NOT list_contains({_STOP}, t) GROUP BY ALL)"""
_TERMS = f"{_TITLES},{_WORDS}"
_TOK = "regexp_extract_all(lower({0}), '[a-z0-9_]+')"


def _ranked(asked: str = _TITLES) -> str:
    """CTEs up to ranked (query, rank, chunk_id, score), for the texts that ``asked`` names q."""
    return rf"""{asked},{_WORDS},
phrases AS (SELECT query, p, count(*) AS n FROM (SELECT query, {_TOK.format('t')} AS p FROM terms) WHERE len(p) > 0 GROUP BY ALL),
docs AS (SELECT chunk_id, max({{'a': coalesce(title, ''), 'b': coalesce(array_to_string(heading_path, ' > '), ''), 'c': coalesce(text, '')}}) AS d FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
fields AS (SELECT chunk_id, 3.0::DOUBLE AS w, 1 AS f, {_TOK.format('d.a')} AS t FROM docs UNION ALL SELECT chunk_id, 2.0, 2, {_TOK.format('d.b')} FROM docs UNION ALL SELECT chunk_id, 1.0, 3, {_TOK.format('d.c')} FROM docs),
lengths AS (SELECT chunk_id, sum(len(t))::DOUBLE AS n FROM fields GROUP BY chunk_id),
size AS (SELECT count(*)::DOUBLE AS n_docs, sum(n) / count(*) AS avgdl FROM lengths),
tokens AS (SELECT chunk_id, w, f, unnest(t) AS t1, generate_subscripts(t, 1) AS i FROM fields),
grams AS (SELECT *, lead(t1, 1) OVER o AS t2, lead(t1, 2) OVER o AS t3, lead(t1, 3) OVER o AS t4, lead(t1, 4) OVER o AS t5 FROM tokens WINDOW o AS (PARTITION BY chunk_id, f ORDER BY i)),
dp AS (SELECT DISTINCT p FROM phrases),
tf AS (SELECT p, chunk_id, sum(w) AS f FROM dp JOIN grams ON p[1] = t1 WHERE (len(p) < 2 OR p[2] = t2) AND (len(p) < 3 OR p[3] = t3) AND (len(p) < 4 OR p[4] = t4) AND (len(p) < 5 OR p[5] = t5) GROUP BY ALL),
idf AS (SELECT p, ln((n_docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS raw FROM tf, size GROUP BY p, n_docs),
part AS (SELECT p, chunk_id, (CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / avgdl)) AS s FROM tf JOIN idf USING (p) JOIN lengths USING (chunk_id), size),
scored AS (SELECT query, chunk_id, round(sum(s * n), 9) AS score FROM phrases JOIN part USING (p) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id)::INT AS rank FROM scored)"""


def _listed(name: str, rows: str, depth: int) -> str:
    """CTE of a ranked list (query_id, rank, chunk_id, score) without stubs and later hits of a page, cut to ``depth``."""
    return f"""{name} AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id)::INT AS rank, chunk_id, page, score FROM (
  SELECT l.*, coalesce(pm.page, '') AS page, row_number() OVER (PARTITION BY query_id, coalesce(pm.page, '') ORDER BY rank, chunk_id) AS n FROM ({rows}) l LEFT JOIN pm USING (chunk_id) WHERE coalesce(status, 'ok') = 'ok') WHERE n = 1
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) <= {depth})"""


_PROBES = """usable AS (SELECT chunk_id, vec FROM dense_index WHERE len(vec) = 64 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
probes AS (SELECT u.chunk_id AS query_id, coalesce(max(title), '') AS query, min(vec) AS vec FROM usable u JOIN chunks c USING (chunk_id) WHERE ('0x' || right(chunk_id, 4))::BIGINT % 100 = 0 GROUP BY u.chunk_id),
e AS (SELECT DISTINCT chunk_id, vec::DOUBLE[] AS e FROM usable WHERE chunk_id IS NOT NULL),
cosines AS (SELECT query_id, chunk_id, max(round(list_dot_product(p.vec::DOUBLE[], e) / (sqrt(list_dot_product(p.vec::DOUBLE[], p.vec::DOUBLE[])) * sqrt(list_dot_product(e, e))), 9)) AS score FROM probes p, e GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cosines QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 500)"""


_COLLAPSED = f"""WITH {_RUNS}, {_PAGES},
hits AS (SELECT r.query_id, r.rank, r.chunk_id, coalesce(pm.page, '') AS page, coalesce(pm.status, 'ok') AS status FROM runs r LEFT JOIN pm USING (chunk_id) WHERE system = 'bm25'),
grid AS (
  SELECT s AS exclude_stubs, c AS collapse_aliases, h.* FROM hits h, (VALUES (true, true), (true, false), (false, true), (false, false)) v(s, c) WHERE NOT s OR status = 'ok'),
firsts AS (SELECT *, row_number() OVER (PARTITION BY exclude_stubs, collapse_aliases, query_id, page ORDER BY rank, chunk_id) AS n FROM grid),
listed AS (SELECT *, row_number() OVER (PARTITION BY exclude_stubs, collapse_aliases, query_id ORDER BY rank, chunk_id)::INT AS r FROM firsts WHERE n = 1 OR NOT collapse_aliases)"""
_SAID = "(" + " OR ".join(f"contains(lower(text), '{p}')" for p in STUB_PHRASES) + ")"


def _signed(moved: bool = False) -> str:
    """CTEs up to signed (url, n_chunks, n_tokens, signature, stub); with ``moved`` over the texts that say so."""
    text = "CASE WHEN right(chunk_id, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN coalesce(text, '') || ' It has been moved.' ELSE coalesce(text, '') END" if moved else "coalesce(text, '')"
    return rf"""WITH RECURSIVE said AS (SELECT url, chunk_id, ordinal, coalesce(n_tokens, 0) AS n_tokens, {text} AS text FROM chunks WHERE url IS NOT NULL),
parts AS (SELECT DISTINCT ON (url, chunk_id, ordinal) * FROM (SELECT *, sha256(regexp_replace(text, {_DOTTED})) AS h FROM said) ORDER BY url, chunk_id, ordinal, n_tokens, h),
ranges AS (SELECT url, ordinal // 4096 AS r, count(*) AS n, sum(n_tokens) AS t, sha256(string_agg(h, chr(10) ORDER BY ordinal, chunk_id)) AS d FROM parts GROUP BY ALL),
opening AS (SELECT url, {_SAID} AS says FROM parts QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal, chunk_id) = 1),
signed AS (SELECT url, sum(n)::BIGINT AS n_chunks, sum(t)::BIGINT AS n_tokens, sha256(string_agg(d, chr(10) ORDER BY r)) AS signature, sum(n) = 1 AND sum(t) <= 80 AND any_value(says) AS stub FROM ranges JOIN opening USING (url) GROUP BY url)"""


_PATH = rf"""{_BASE} AS b, '\.' || array_to_string(list_transform(string_split({_BASE}, '.'), lambda s: regexp_escape(s)), '\.(.*\.)?') || '\.' AS p,
  array_to_string(list_sort(list_distinct(regexp_extract_all({_BASE}, '\b(cuda|xpu|mtia|mps|cpu|hpu|npu)\b'))), ',') AS v"""
# first fit in url order: each page takes the first cluster none of whose members it contradicts
_CLUSTERS = rf""",
paths AS (SELECT signature, url, {_PATH} FROM signed),
g AS (SELECT signature, list(url ORDER BY url) AS us, list(b ORDER BY url) AS bs, list(p ORDER BY url) AS ps, list(v ORDER BY url) AS vs FROM paths GROUP BY signature HAVING count(*) > 1),
f AS (SELECT signature, us, bs, ps, vs, [1] AS cl FROM g UNION ALL
  SELECT signature, us, bs, ps, vs, list_append(cl, list_min(list_filter(range(1, list_max(cl) + 2), lambda c: len(list_filter(range(1, len(cl) + 1), lambda j: cl[j] = c AND NOT (vs[j] = vs[len(cl) + 1]
    AND (bs[j] = '' OR bs[len(cl) + 1] = '' OR regexp_matches('.' || bs[len(cl) + 1] || '.', ps[j]) OR regexp_matches('.' || bs[j] || '.', ps[len(cl) + 1]))))) = 0))::INT) FROM f WHERE len(cl) < len(us)),
placed AS (SELECT signature, unnest(us) AS url, unnest(cl) AS c FROM f WHERE len(cl) = len(us)),
clusters AS (SELECT signature, url, first_value(url) OVER (PARTITION BY signature, c ORDER BY length(url), url) AS canonical_url, count(*) OVER (PARTITION BY signature, c) AS size FROM placed)"""
_ANALYSIS = _CLUSTERS + """,
analysis AS (SELECT s.url, coalesce(c.canonical_url, s.url) AS canonical_url, CASE WHEN stub THEN 'stub' ELSE 'ok' END AS status FROM signed s LEFT JOIN (SELECT url, canonical_url FROM clusters WHERE size > 1) c USING (url))"""
_LOADED = """WITH c AS (SELECT chunk_id, max({'url': url, 'anchor': anchor, 'title': title, 'heading_path': heading_path, 'ordinal': ordinal, 'text': text}) AS v FROM (SELECT DISTINCT ON (chunk_id, url, ordinal, text) * FROM chunks) GROUP BY chunk_id),
t AS (SELECT DISTINCT chunk_id, url, ordinal, title, trim(text, ' ') AS text FROM chunks WHERE contains(url, '/tutorials/') AND chunk_id IS NOT NULL QUALIFY ordinal < max(ordinal) OVER (PARTITION BY url)),
b AS (SELECT chunk_id, url, ordinal, title, text FROM t QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY coalesce(text, '') DESC, url DESC, ordinal DESC) = 1)"""
_RATINGS = "WITH r AS (SELECT CASE WHEN n_chars < 300 THEN 0 WHEN n_chars < 1000 THEN 1 ELSE 2 END AS original, CASE WHEN length(text) < 300 THEN 0 WHEN length(text) < 1000 THEN 1 ELSE 2 END AS regrade FROM documents WHERE n_chars IS NOT NULL AND text IS NOT NULL)"
_CASE5 = r"regexp_extract(query_id, '(\d+)$', 1)::INT"
_ROUTES = rf"routes AS (SELECT query_id, query_id AS query, CASE WHEN {_CASE5} % 5 IN (0, 4) THEN 'decompose' ELSE 'direct' END AS route, CASE WHEN {_CASE5} % 5 = 0 THEN 'two parts' ELSE '' END AS reason, {_CASE5} % 5 IN (2, 3) AS route_fallback FROM asked)"
_ANSWERS = rf"""{_EVAL},
heads AS (SELECT system, query_id, count(*) AS k FROM runs WHERE rank <= 3 GROUP BY ALL),
a AS (SELECT h.*, category, {_CASE5} AS n, {_CASE5} % 11 = 0 AS refused, {_CASE5} % 11 <> 0 AND {_CASE5} % 13 = 0 AS bad FROM heads h JOIN asked USING (query_id)),
b AS (SELECT *, NOT refused AND NOT bad AS scored, (1 <= k)::INT + (n % 5 + 1 <= k)::INT AS cited FROM a),
v AS (SELECT system, category, query_id, unnest([1, 2, 3]) AS claim, n FROM b WHERE scored),
w AS (SELECT *, claim <= 2 AS judged, claim = 2 OR (claim = 1 AND n % 2 = 0) AS supported FROM v)"""


_CONTEXTS = """WITH l AS (SELECT DISTINCT query_id, chunk_id, best_rank FROM fused), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_rank, chunk_id) AS rank FROM l),
details AS (SELECT chunk_id, max({'text': coalesce(text, ''), 'title': title, 'heading_path': coalesce(heading_path, [])}) AS d FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
j AS (SELECT r.*, d, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM r JOIN details USING (chunk_id) WHERE rank <= 10)"""
_CONTEXT = "string_agg('[C' || i || '] ' || array_to_string(list_filter([d.title, array_to_string(d.heading_path, ' > ')], lambda x: x IS NOT NULL AND x <> ''), ' | ') || chr(10) || d.text, chr(10) || chr(10) ORDER BY i)"


def _prompt(template: str, **values: str) -> str:
    """SQL of a template with columns in its slots."""
    sql = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", f"' || {value} || '")
    return sql


def oracle_sql() -> dict[str, str]:
    return {
        "bm25_topk": f"WITH {_ranked()} SELECT query AS query_id, rank, chunk_id AS doc, score FROM ranked WHERE rank <= 10",
        "match_terms": f"""WITH {_TERMS} SELECT q.query, coalesce(string_agg('"' || t || '"', ' OR ' ORDER BY spot), '') AS expression FROM q LEFT JOIN terms ON terms.query = q.query GROUP BY q.query""",
        "dense_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (q.l * v.l), 9) AS score FROM n q, n v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
        "dense_stats": "SELECT count(*) AS n_vectors, 64 AS dim, count(*) * 64 * 4 AS matrix_bytes FROM dense_index WHERE len(vec) = 64",
        "rerank_overlap": f"""WITH base0 AS (SELECT DISTINCT title AS query_id, chunk_id FROM chunks WHERE title IS NOT NULL), base AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS base_rank FROM base0),
texts AS (SELECT chunk_id, max(coalesce(text, '')) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
s AS (SELECT query_id, base_rank, chunk_id, list_distinct({_TOK.format('query_id')}) AS asked, list_distinct({_TOK.format('text')}) AS held FROM base JOIN texts USING (chunk_id)),
t AS (SELECT query_id, base_rank, chunk_id, round(CASE WHEN len(asked) = 0 THEN 0 ELSE len(list_intersect(asked, held)) / len(asked)::DOUBLE END, 9) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_rank, chunk_id)::INT AS rank FROM t) SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 10""",
        "rrf_fusion": _fuse(100, False) + " SELECT query_id, r AS rank, chunk_id, page, score, best_rank FROM best WHERE r <= 10",
        "rrf_compact": _fuse(10, True) + " SELECT query_id, r AS rank, chunk_id, page, score, best_rank FROM best WHERE r <= 10",
        "rrf_explain": _fuse(100, False) + " SELECT query_id, page, system, p.rank AS system_rank FROM placed p JOIN best USING (query_id, page) WHERE r <= 10",
        "rrf_items": f"WITH {_RUNS} SELECT query_id, chunk_id AS item, round(sum(1e0 / (60 + rank)), 12) AS score FROM runs GROUP BY ALL",
        "alias_collapse": _COLLAPSED + " SELECT query_id, r AS rank, chunk_id, page FROM listed WHERE exclude_stubs AND collapse_aliases AND r <= 10",
        "policy_grid": _COLLAPSED + " SELECT exclude_stubs, collapse_aliases, count(*) AS n_slots, count(DISTINCT page) AS n_pages FROM listed WHERE r <= 10 GROUP BY ALL",
        "changed_lists": _COLLAPSED + ", l AS (SELECT query_id, list(chunk_id ORDER BY r) FILTER (NOT collapse_aliases) AS a, list(chunk_id ORDER BY r) FILTER (collapse_aliases) AS b FROM listed WHERE exclude_stubs AND r <= 10 GROUP BY query_id) SELECT a IS DISTINCT FROM b AS changed, count(*) AS n FROM l GROUP BY ALL",
        "duplicate_slots": f"WITH {_RUNS}, {_PAGES}, h AS (SELECT r.*, coalesce(page, '') AS page, coalesce(status, 'ok') AS status FROM runs r LEFT JOIN pm USING (chunk_id) WHERE rank <= 10), n AS (SELECT *, row_number() OVER (PARTITION BY system, query_id, page ORDER BY rank, chunk_id) AS i FROM h) SELECT system, query_id, count(*) AS n_slots, count(*) FILTER (i > 1) AS n_duplicates, count(*) FILTER (status <> 'ok') AS n_stubs FROM n GROUP BY ALL",
        "p5_found": r"""
WITH r AS (
  SELECT snapshot_id, nullif(regexp_replace(lower(chunk_id), '[\s ]+', '', 'g'), '') AS c, right(nullif(regexp_replace(lower(content_hash), '[\s ]+', '', 'g'), ''), 16) AS h,
    try_cast(fetched_at AS TIMESTAMPTZ) AS f, loaded_at FROM chunk_snapshots WHERE snapshot_id IS NOT NULL),
u AS (SELECT snapshot_id, c, h FROM r WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_id, c ORDER BY f DESC NULLS LAST, loaded_at DESC NULLS LAST, h DESC NULLS LAST) = 1),
s AS (SELECT snapshot_id, row_number() OVER (ORDER BY snapshot_id) AS n FROM (SELECT DISTINCT snapshot_id FROM u)),
x AS (SELECT u.*, s.n FROM u JOIN s USING (snapshot_id))
SELECT s.snapshot_id, coalesce(a.c, b.c) AS chunk_id, CASE WHEN a.c IS NULL THEN 'added' WHEN b.c IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM x a FULL JOIN x b ON a.n + 1 = b.n AND a.c = b.c JOIN s ON s.n = coalesce(b.n, a.n + 1)
WHERE s.n > 1 AND (a.c IS NULL OR b.c IS NULL OR a.h <> b.h)""",
        "page_signatures": _signed() + " SELECT url, n_chunks, n_tokens, signature FROM signed",
        "stub_pages": _signed(True) + " SELECT url FROM signed WHERE stub",
        "alias_groups": _signed() + _CLUSTERS + " SELECT canonical_url, list(url ORDER BY url) AS urls FROM clusters WHERE size > 1 GROUP BY signature, canonical_url",
        "text_only_collisions": _signed() + _CLUSTERS + " SELECT count(*) AS collisions FROM (SELECT signature FROM clusters GROUP BY signature HAVING count(DISTINCT canonical_url) > 1)",
        "quality_analysis": _signed(True) + _ANALYSIS + " SELECT * FROM analysis",
        "quality_report": _signed(True) + _ANALYSIS + " SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_alias_pages, count(*) FILTER (n > 1) AS n_groups, coalesce(sum(n - 1), 0)::BIGINT AS n_redundant, coalesce(sum(s), 0)::BIGINT AS n_stubs FROM (SELECT canonical_url, count(*) AS n, count(*) FILTER (status = 'stub') AS s FROM analysis GROUP BY canonical_url)",
        "quality_applied": _signed(True) + _ANALYSIS + ", p AS (SELECT p.url, coalesce(a.canonical_url, p.url, '') AS c, coalesce(a.status, 'ok') AS status FROM pages p LEFT JOIN analysis a USING (url)) SELECT count(*) FILTER (status <> 'ok') AS stubs, count(*) FILTER (c <> '' AND c <> url) AS redundant, count(*) FILTER (c = '') AS unanalyzed FROM p",
        "reported_aliases": rf"""WITH g AS (SELECT DISTINCT report_id, g FROM (SELECT report_id, unnest(alias_groups) AS g FROM quality_report)),
u AS (SELECT report_id, list_min(list_transform(g, lambda u: {{'n': length(u), 'u': u}})).u AS canonical_url, unnest(g) AS url FROM g),
paths AS (SELECT url, {_PATH} FROM (SELECT url FROM u UNION SELECT canonical_url FROM u))
SELECT u.*, a.v = x.v AND (a.b = '' OR x.b = '' OR regexp_matches('.' || x.b || '.', a.p) OR regexp_matches('.' || a.b || '.', x.p)) AS compatible FROM u JOIN paths a ON a.url = u.canonical_url JOIN paths x ON x.url = u.url""",
        "quality_counts": "SELECT count(*) FILTER (status <> 'ok') AS stubs, count(*) FILTER (coalesce(canonical_url, '') <> '' AND canonical_url <> url) AS redundant, count(*) FILTER (coalesce(canonical_url, '') = '') AS unanalyzed FROM pages",
        "canonical_map": "SELECT DISTINCT url, canonical_url FROM pages WHERE canonical_url <> '' AND canonical_url <> url",
        "stub_urls": "SELECT DISTINCT url FROM pages WHERE status <> 'ok'",
        "upsert_load": _LOADED + """ SELECT count(DISTINCT b.url) AS pages, count(*) AS chunks, count(*) FILTER (c.chunk_id IS NULL) AS inserted, count(*) FILTER (b.text IS DISTINCT FROM c.v.text) AS updated,
  (SELECT count(*) FROM c WHERE c.v.url IN (SELECT url FROM b) AND c.chunk_id NOT IN (SELECT chunk_id FROM b)) AS deleted FROM b LEFT JOIN c USING (chunk_id)""",
        "upsert_chunks": _LOADED + " SELECT chunk_id, v.url AS url, md5(v.text) AS text_md5 FROM c WHERE v.url NOT IN (SELECT url FROM b) AND chunk_id NOT IN (SELECT chunk_id FROM b) UNION ALL SELECT chunk_id, url, md5(text) FROM b",
        "upsert_pages": _LOADED + """, h AS (SELECT url, title, count(*) OVER (PARTITION BY url)::INT AS n FROM b QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal, chunk_id) = 1)
SELECT url, title, n_chunks, coalesce(canonical_url, '') AS canonical_url, coalesce(status, 'ok') AS status FROM pages WHERE url NOT IN (SELECT url FROM b)
UNION ALL SELECT h.url, coalesce(h.title, ''), n, coalesce(max(p.canonical_url), ''), coalesce(max(p.status), 'ok') FROM h LEFT JOIN pages p USING (url) GROUP BY h.url, h.title, n""",
        "corpus_counts": "SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM pages) AS pages",
        "located_chunks": "SELECT chunk_id, p.url, p.anchor FROM (SELECT chunk_id, min({'url': url, 'anchor': coalesce(anchor, '')}) AS p FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM rankings) GROUP BY chunk_id)",
        "chunk_fields": rf"""WITH {_CHUNKS}, f AS (SELECT *, trim(regexp_replace(text, {_SP}, ' ', 'g'), ' ') AS flat FROM c)
SELECT chunk_id, ordinal, CASE WHEN length(flat) > 220 THEN rtrim(left(flat, 220), ' ') || '...' ELSE flat END AS snippet, coalesce(array_to_string(heading_path[greatest(len(heading_path) - 1, 1):], ' > '), '') AS section,
  CASE WHEN coalesce(anchor, '') <> '' THEN url || '#' || anchor ELSE url END AS unit, CASE WHEN contains(url, '/tutorials/') THEN 'tutorials' ELSE 'docs' END AS source, left(sha256(text), 16) AS hash,
  CASE WHEN text IS NOT NULL THEN len(list_filter(string_split_regex(text, {_SP}), lambda w: w <> ''))::INT END AS n_words, md5(regexp_replace(text, {_DOTTED})) AS short_md5,
  md5(array_to_string(list_filter([title, coalesce(array_to_string(heading_path, ' > '), ''), text], lambda x: x IS NOT NULL AND x <> ''), chr(10))) AS embed_md5 FROM f""",
        "chunk_ids": f"WITH {_CHUNKS}, n AS (SELECT *, row_number() OVER (PARTITION BY url, heading_path ORDER BY ordinal, chunk_id) - 1 AS i FROM c WHERE heading_path IS NOT NULL) SELECT chunk_id, url, ordinal, left(sha256(url || chr(0) || array_to_string(heading_path, '/') || chr(0) || i), 16) AS positional_id FROM n",
        "url_fields": rf"WITH p AS (SELECT DISTINCT url, {_BASE} AS b FROM pages) SELECT url, replace(b, '.', '|') AS segments, array_to_string(list_sort(list_distinct(regexp_extract_all(b, '\b(cuda|xpu|mtia|mps|cpu|hpu|npu)\b'))), '|') AS devices, CASE WHEN m = '' OR m LIKE '%/' THEN m || 'index.html' ELSE m END AS mirror FROM (SELECT *, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1), '^/+', '') AS m FROM p)",
        "sitemap_urls": "SELECT DISTINCT replace(url, '/stable/', '/3.2/') AS url FROM pages WHERE url IS NOT NULL AND NOT contains(url, '/notes/')",
        "length_stats": "SELECT count(n_tokens) AS chunks, sum(n_tokens)::BIGINT AS tokens, round_even(avg(n_tokens), 1) AS mean, "
        + ", ".join(f"round_even(quantile_cont(n_tokens, {q / 100}), 0)::BIGINT AS p{q}" for q in (5, 25, 50, 75, 95))
        + ', max(n_tokens)::BIGINT AS "max" FROM chunks',
        "length_histogram": """WITH e AS (SELECT unnest([0, 50, 100, 150, 200, 250, 300, 350, 400, 450, 512]) AS lo, unnest([50, 100, 150, 200, 250, 300, 350, 400, 450, 512, NULL]) AS hi, unnest(range(11))::INT AS bin)
SELECT bin, CASE WHEN hi IS NULL THEN lo || '+' ELSE lo || '-' || (hi - 1) END AS range, count(n_tokens) AS count FROM e LEFT JOIN chunks ON n_tokens >= lo AND (hi IS NULL OR n_tokens < hi) GROUP BY bin, lo, hi""",
        "source_breakdown": "WITH per AS (SELECT url, count(*) AS n, sum(n_tokens) AS t FROM chunks GROUP BY url) SELECT CASE WHEN contains(p.url, '/tutorials/') THEN 'tutorials' ELSE 'docs' END AS source, count(*) AS pages, count(*) FILTER (n > 0) AS pages_with_content, coalesce(sum(n), 0)::BIGINT AS chunks, coalesce(sum(t), 0)::BIGINT AS tokens FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL) p LEFT JOIN per USING (url) GROUP BY 1",
        "short_chunks": "WITH per AS (SELECT url, count(*) AS n, count(*) FILTER (n_tokens < 40) AS s FROM chunks GROUP BY url) SELECT sum(s)::BIGINT AS under_min_tokens, coalesce(sum(s) FILTER (n = 1), 0)::BIGINT AS whole_page, (sum(s) - coalesce(sum(s) FILTER (n = 1), 0))::BIGINT AS fragments FROM per",
        "analyzed_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY term",
        "metrics_per_query": _SCORES + " SELECT system, query_id, category, judged, n_relevant, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("recall_5", "recall_10", "mrr", "ndcg_10", "ceiling_5", "ceiling_10")) + " FROM scores",
        "metrics_summary": _SCORES + " SELECT system, CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, count(*) AS n, "
        + ", ".join(f"round(avg({c}), 9) AS {c}" for c in ("recall_5", "recall_10", "mrr", "ndcg_10", "ceiling_5", "ceiling_10"))
        + ", " + ", ".join(f"round(avg(recall_{k} / ceiling_{k}), 9) AS mean_share_{k}, round(avg(recall_{k}) / avg(ceiling_{k}), 9) AS share_of_means_{k}" for k in (5, 10)) + " FROM scores GROUP BY GROUPING SETS ((system), (system, category))",
        "ceiling": _EVAL + ", r AS (SELECT query_id, count(*)::DOUBLE AS r FROM qrels WHERE grade > 0 GROUP BY query_id) SELECT CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, count(*) AS n, round(avg(least(5, r) / r), 9) AS ceiling FROM asked JOIN r USING (query_id) GROUP BY GROUPING SETS ((), (category))",
        "win_loss_tie": _SCORES + " SELECT count(*) FILTER (d > 1e-12) AS wins, count(*) FILTER (d < -1e-12) AS losses, count(*) FILTER (abs(d) <= 1e-12) AS ties, count(*) AS n FROM (SELECT a.recall_10 - b.recall_10 AS d FROM scores a JOIN scores b USING (query_id) WHERE a.system = 'rerank' AND b.system = 'bm25')",
        "pool_union": _POOL + f""", t AS (SELECT p.*, d.d, trim(regexp_replace(d.d.text, {_SP}, ' ', 'g'), ' ') AS flat FROM pooled p JOIN details d USING (chunk_id))
SELECT query_id, url, coalesce(d.title, '') AS title, coalesce(array_to_string(d.heading_path[greatest(len(d.heading_path) - 1, 1):], ' > '), '') AS section, CASE WHEN length(flat) > 220 THEN rtrim(left(flat, 220), ' ') || '...' ELSE flat END AS snippet, found_by FROM t""",
        "pool_delta": _POOL + " SELECT a.query_id, a.category, count(p.url) FILTER (j.url IS NULL) AS n_new, count(j.url) AS n_already_judged FROM asked a LEFT JOIN pooled p ON p.query_id = a.query_id LEFT JOIN judged j ON j.query_id = p.query_id AND j.url = p.url GROUP BY ALL",
        "coverage": _POOL + """, m AS (SELECT a.query_id, a.category, p.url, p.url IS NOT NULL AND j.url IS NULL AS fresh FROM asked a LEFT JOIN pooled p ON p.query_id = a.query_id LEFT JOIN judged j ON j.query_id = p.query_id AND j.url = p.url),
per AS (SELECT query_id, category, count(url) AS n, count(*) FILTER (fresh) AS f FROM m GROUP BY ALL),
s AS (SELECT CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, count(*) AS n_queries, sum(n)::BIGINT AS retrieved, sum(f)::BIGINT AS unjudged, count(*) FILTER (f = 0) AS fully_covered FROM per GROUP BY GROUPING SETS ((), (category))),
u AS (SELECT CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, count(DISTINCT url) AS distinct_new_pages FROM m WHERE fresh GROUP BY GROUPING SETS ((), (category)))
SELECT s.category, n_queries, retrieved, unjudged, round(coalesce(unjudged / nullif(retrieved, 0)::DOUBLE, 0), 9) AS rate, coalesce(distinct_new_pages, 0) AS distinct_new_pages, fully_covered FROM s LEFT JOIN u USING (category)""",
        "system_coverage": _POOL + ", r AS (SELECT DISTINCT system, query_id, page AS url FROM top UNION SELECT 'union', query_id, page FROM top) SELECT system, count(*) AS pooled, count(*) FILTER (j.url IS NULL) AS unjudged, round(count(*) FILTER (j.url IS NULL) / count(*)::DOUBLE, 9) AS rate FROM r LEFT JOIN judged j USING (query_id, url) GROUP BY system",
        "append_judgments": _EVAL + ", new AS (SELECT DISTINCT query_id, unit, 2 AS grade FROM units WHERE rank = 1) SELECT * FROM qrels UNION ALL SELECT * FROM new WHERE (query_id, unit) NOT IN (SELECT (query_id, unit) FROM qrels)",
        "append_conflicts": _EVAL + ", new AS (SELECT DISTINCT query_id, unit, 2 AS grade FROM units WHERE rank = 1) SELECT * FROM new WHERE (query_id, unit) IN (SELECT (query_id, unit) FROM qrels)",
        "merge_judgments": _EVAL + ", new AS (SELECT DISTINCT query_id, unit, 2 AS grade FROM units WHERE rank = 1) SELECT * FROM qrels WHERE query_id NOT IN (SELECT query_id FROM new) UNION ALL SELECT * FROM new",
        "kappa": _RATINGS + ", n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (original = regrade) AS same FROM r), m AS (SELECT sum(a.c * b.c)::DOUBLE AS m FROM (SELECT original AS g, count(*) AS c FROM r GROUP BY 1) a JOIN (SELECT regrade AS g, count(*) AS c FROM r GROUP BY 1) b USING (g)) SELECT n::BIGINT AS n, round((same / n - m / (n * n)) / (1 - m / (n * n)), 9) AS kappa, round(same / n, 9) AS observed, round(m / (n * n), 9) AS chance FROM n, m",
        "confusion": _RATINGS + " SELECT g AS original, count(*) FILTER (regrade = 0) AS g0, count(*) FILTER (regrade = 1) AS g1, count(*) FILTER (regrade = 2) AS g2 FROM (SELECT unnest([0, 1, 2]) AS g) LEFT JOIN r ON original = g GROUP BY g",
        "reproduction": _RATINGS + " SELECT original, count(*) FILTER (original = regrade) AS same, count(*) AS total, round(count(*) FILTER (original = regrade) / count(*)::DOUBLE, 9) AS share FROM r GROUP BY original",
        "fisher": """WITH p AS (SELECT section, count(*) FILTER (length(text) >= 1000) AS a, count(*) FILTER (length(text) < 1000) AS b FROM documents WHERE text IS NOT NULL AND section IS NOT NULL GROUP BY section),
t AS (SELECT *, (SELECT sum(a) FROM p)::BIGINT - a AS c, (SELECT sum(b) FROM p)::BIGINT - b AS d FROM p),
x AS (SELECT *, unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) AS i FROM t),
l AS (SELECT section, a, b, c, d, i, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS k, lgamma(i + 1) + lgamma(a + b - i + 1) + lgamma(a + c - i + 1) + lgamma(d - a + i + 1) AS s, lgamma(a + 1) + lgamma(b + 1) + lgamma(c + 1) + lgamma(d + 1) AS seen FROM x)
SELECT section, a, b, c, d, round(least(1.0, sum(exp(k - s)) FILTER (exp(k - s) <= exp(k - seen) * (1 + 1e-9))), 6) AS p_value FROM l GROUP BY section, a, b, c, d""",
        "latency_percentiles": "WITH l AS (SELECT event_type, list_sort(list(value)) AS v, avg(value) AS m FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, len(v)::BIGINT AS n, v[1] AS min_s, v[least(floor(0.5 * len(v))::INT, len(v) - 1) + 1] AS p50, v[least(floor(0.9 * len(v))::INT, len(v) - 1) + 1] AS p90, v[-1] AS max_s, round(m, 6) AS mean_s FROM l",
        "latency_stats": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean_s, round(quantile_cont(value, 0.5), 6) AS median_s, max(value) AS max_s FROM events GROUP BY event_type",
        "json_members": "SELECT event_type, count(json_extract(props, '$.k')::BIGINT) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, count(*) FILTER (json_type(props, '$.k') = 'VARCHAR') AS n_strings FROM events GROUP BY event_type",
        "agent_routes": f"WITH {_ASKED}, {_ROUTES} SELECT * FROM routes",
        "agent_sub_queries": f"WITH {_ASKED}, {_ROUTES}, p AS (SELECT query_id, route = 'decompose' AND {_CASE5} % 2 = 1 AS decompose_fallback, CASE WHEN route = 'decompose' AND {_CASE5} % 2 = 0 THEN ['a', 'b', 'c'] ELSE [query] END AS s FROM routes) SELECT query_id, decompose_fallback, generate_subscripts(s, 1)::INT - 1 AS sub_no, unnest(s) AS sub_query FROM p",
        "trace_summary": "WITH t AS (SELECT *, event_id % 3 = 0 AS dec, value / 4 AS r, value + value / 4 AS t FROM events) SELECT count(*) AS n, count(*) FILTER (dec) AS route_decompose, count(*) FILTER (NOT dec) AS route_direct, count(*) FILTER (event_id % 7 = 0) AS route_fallbacks, count(*) FILTER (event_id % 6 = 0) AS decompose_fallbacks, round(count(*) FILTER (event_id % 6 = 0) / count(*) FILTER (dec)::DOUBLE, 6) AS decompose_fallback_rate, sum(event_id % 3 + 1)::BIGINT AS sub_queries_total, round(avg(event_id % 3 + 1), 6) AS sub_queries_mean, count(*) AS llm_calls, count(*) AS cache_hits, sum(user_id)::BIGINT AS prompt_tokens, count(*) AS completion_tokens, "
        + ", ".join(f"round(avg({c}), 6) AS {n}_mean_s, round(quantile_cont({c}, 0.5), 6) AS {n}_median_s, round(max({c}), 6) AS {n}_max_s, round(sum({c}), 6) AS {n}_sum_s" for n, c in (("llm", "value"), ("retrieval", "r"), ("total", "t")))
        + ", round(sum(value) / sum(t), 6) AS model_share FROM t",
        "contexts": """WITH l AS (SELECT DISTINCT query_id, chunk_id, best_rank FROM fused), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_rank, chunk_id) AS rank FROM l),
details AS (SELECT chunk_id, max({'text': coalesce(text, ''), 'title': title, 'heading_path': coalesce(heading_path, [])}) AS d FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
j AS (SELECT r.*, d, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM r JOIN details USING (chunk_id) WHERE rank <= 10)
SELECT query_id, count(*)::INT AS n, md5(string_agg(chunk_id, ',' ORDER BY i)) AS ids_md5, md5(string_agg('[C' || i || '] ' || array_to_string(list_filter([d.title, array_to_string(d.heading_path, ' > ')], lambda x: x IS NOT NULL AND x <> ''), ' | ') || chr(10) || d.text, chr(10) || chr(10) ORDER BY i)) AS context_md5 FROM j GROUP BY query_id""",
        "answer_summary": _ANSWERS + " SELECT system, count(*) AS n, count(*) FILTER (refused) AS refused, count(*) FILTER (bad) AS malformed, count(*) FILTER (scored AND cited < 2) AS with_dangling, round(avg(n / 10e0), 9) AS mean_model_s FROM b GROUP BY system",
        "citation_table": _ANSWERS + " SELECT CASE WHEN grouping(system) = 1 THEN 'all' ELSE system END AS system, count(*) AS scored_answers, sum(cited)::BIGINT AS citations, sum(2 - cited)::BIGINT AS dangling, round(sum(2 - cited) / (2e0 * count(*)), 9) AS dangling_rate, count(*) FILTER (cited = 0) AS uncited FROM b WHERE scored GROUP BY ROLLUP (system)",
        "support_table": _ANSWERS + " SELECT CASE WHEN grouping(system) = 1 THEN 'all' ELSE system END AS system, CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, count(*) AS claims, count(*) FILTER (judged) AS judged, round(count(*) FILTER (supported) / count(*)::DOUBLE, 9) AS rate_all, round(count(*) FILTER (supported AND judged) / (count(*) FILTER (judged))::DOUBLE, 9) AS rate_judged FROM w GROUP BY CUBE (system, category)",
        "mismatch_pairs": f"WITH {_ASKED}, o AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS i, count(*) OVER () AS n FROM asked) SELECT a.query_id, b.query_id AS donor_id FROM o a JOIN o b ON b.i = (a.i + 20) % a.n",
        "probe_pairs": _EVAL + """, o AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS i, count(*) OVER () AS n FROM asked), pairs AS (SELECT a.query_id, b.query_id AS donor_id FROM o a JOIN o b ON b.i = (a.i + 20) % a.n),
rel AS (SELECT DISTINCT q.query_id, coalesce(p.page, q.unit) AS page FROM qrels q LEFT JOIN (SELECT DISTINCT url, page FROM pm) p ON p.url = q.unit WHERE grade >= 1),
ctx AS (SELECT DISTINCT r.query_id AS donor_id, page FROM runs r JOIN pm USING (chunk_id) WHERE system = 'bm25' AND rank <= 10)
SELECT query_id, donor_id, EXISTS (SELECT 1 FROM ctx JOIN rel USING (page) WHERE ctx.donor_id = pairs.donor_id AND rel.query_id = pairs.query_id) AS skipped FROM pairs""",
        "dense_search": f"WITH {_PROBES}, {_PAGES}, {_listed('l', 'SELECT * FROM near', 10)} SELECT query_id, rank, chunk_id, page, score FROM l",
        "hybrid_search": f"""WITH {_PROBES}, {_PAGES}, {_ranked('q AS (SELECT DISTINCT query FROM probes)')},
texts AS (SELECT query_id, r.rank, r.chunk_id, r.score FROM probes p JOIN ranked r USING (query) WHERE r.rank <= 500), {_listed('l0', 'SELECT * FROM texts', 100)}, {_listed('l1', 'SELECT * FROM near', 100)},
both_lists AS (SELECT *, 0 AS o FROM l0 UNION ALL SELECT *, 1 AS o FROM l1), known_pages AS (SELECT b.* EXCLUDE (page), pm.page FROM both_lists b JOIN pm USING (chunk_id)),
firsts AS (SELECT * FROM known_pages QUALIFY row_number() OVER (PARTITION BY query_id, o, page ORDER BY rank, chunk_id) = 1),
fused_pages AS (SELECT query_id, page, round(sum(1e0 / (60 + rank)), 12) AS score, min(rank) AS best_rank, arg_min(chunk_id, rank * 10 + o) AS chunk_id FROM firsts GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, page)::INT AS rank, chunk_id, score FROM fused_pages QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, page) <= 10""",
        "live_metrics": f"""WITH {_PAGES}, {_ranked()}, {_listed('l', 'SELECT query AS query_id, rank, chunk_id, score FROM ranked WHERE rank <= 500', 10)},
qrels AS (SELECT DISTINCT title AS query_id, coalesce(k.canonical, p.url) AS unit FROM pages p JOIN known k USING (url) WHERE title IS NOT NULL),
judged AS (SELECT query_id, count(*) AS judged FROM qrels GROUP BY query_id),
units AS (SELECT l.query_id, pm.page AS unit, row_number() OVER (PARTITION BY l.query_id ORDER BY min(rank), pm.page) AS r FROM l JOIN pm USING (chunk_id) GROUP BY l.query_id, pm.page),
found AS (SELECT query_id, count(*) FILTER (r <= 5) AS h5, count(*) FILTER (r <= 10) AS h10, min(r) AS first, sum(3 / log2(r + 1)) FILTER (r <= 10) AS dcg FROM units JOIN qrels USING (query_id, unit) GROUP BY query_id)
SELECT 'bm25' AS system, query_id, judged, judged AS n_relevant, round(coalesce(h5 / judged::DOUBLE, 0), 9) AS recall_5, round(coalesce(h10 / judged::DOUBLE, 0), 9) AS recall_10, round(coalesce(1e0 / first, 0), 9) AS mrr,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(judged, 10) + 1), lambda i: 3 / log2(i + 1))), 0), 9) AS ndcg_10 FROM judged LEFT JOIN found USING (query_id)""",
        "agent_pages": f"""WITH {_PAGES}, subs AS (SELECT DISTINCT title AS query_id, unnest([0, 1]) AS o, unnest([title, title || ' overview']) AS query FROM pages WHERE title IS NOT NULL), {_ranked('q AS (SELECT DISTINCT query FROM subs)')},
hits AS (SELECT s.query_id, s.o, r.rank, r.chunk_id, pm.page FROM subs s JOIN ranked r USING (query) JOIN pm USING (chunk_id) WHERE r.rank <= 10),
firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, o, page ORDER BY rank, chunk_id) = 1),
used AS (SELECT *, row_number() OVER (PARTITION BY query_id, o ORDER BY rank, chunk_id) AS u FROM firsts),
fused_pages AS (SELECT query_id, page, round(sum(1e0 / (60 + u)), 12) AS score, min(rank) AS best_rank, arg_min(chunk_id, rank * 10 + o) AS chunk_id FROM used GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, page)::INT AS rank, chunk_id, page, score, best_rank FROM fused_pages QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, page) <= 10""",
        "hash_embed_topk": f"""WITH w AS (SELECT doc_id, ('0x' || right(sha1(t), 8))::BIGINT % 64 AS d, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS t FROM documents) GROUP BY ALL),
f AS (SELECT doc_id, d, (n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE AS x FROM w), u AS (SELECT doc_id, d, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM f),
s AS (SELECT a.doc_id AS query_id, b.doc_id, round(sum(a.x * b.x), 9) AS score FROM u a JOIN u b USING (d) WHERE a.doc_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10""",
        "corpus_fingerprint": "WITH h AS (SELECT sha256(coalesce(chunk_id, '') || chr(0) || coalesce(content_hash, '')) AS h FROM chunks) SELECT sha256(count(*)::VARCHAR || '|' || "
        + " || '|' || ".join(f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT)::VARCHAR" for i in range(4)) + ") AS fingerprint FROM h",
        "html_blocks": rf"""WITH rows AS (SELECT url, chunk_id, block_ord, min({{'kind': kind, 'text': text, 'heading_path': heading_path, 'lang': lang}}) AS b FROM blocks GROUP BY ALL),
k AS (SELECT *, lower(trim(coalesce(b.kind, ''))) AS kind, coalesce(b.text, '') AS text, CASE WHEN len(b.heading_path) > 0 THEN b.heading_path ELSE ['Untitled'] END AS hp FROM rows),
h AS (SELECT *, first_value(hp) OVER (PARTITION BY url, chunk_id ORDER BY block_ord) AS path, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS lines FROM k),
o AS (SELECT url, chunk_id, block_ord, path, 'code' AS kind, 0 AS i, '```' || coalesce(b.lang, '') || chr(10) || rtrim(text, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || '```' AS text, coalesce(b.lang, 'default') AS lang FROM h WHERE kind = 'code' AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''
  UNION ALL SELECT url, chunk_id, block_ord, path, 'list', generate_subscripts(lines, 1), rtrim('- ' || trim(regexp_replace(regexp_replace(unnest(lines), '^ *(- |\d+\. )', ''), {_SP}, ' ', 'g'), ' '), ' '), '' FROM h WHERE kind = 'list'
  UNION ALL SELECT url, chunk_id, block_ord, path, 'table', 0, array_to_string(list_transform(lines, lambda x: '| ' || array_to_string(list_transform(string_split(regexp_replace(x, '^ *\| ?| ?\| *$', '', 'g'), '|'), lambda c: trim(regexp_replace(c, {_SP}, ' ', 'g'), ' ')), ' | ') || ' |'), chr(10)), '' FROM h WHERE kind = 'table' AND len(lines) > 0
  UNION ALL SELECT url, chunk_id, block_ord, path, 'paragraph', 0, trim(regexp_replace(text, {_SP}, ' ', 'g'), ' '), '' FROM h WHERE kind NOT IN ('code', 'list', 'table') AND trim(regexp_replace(text, {_SP}, ' ', 'g'), ' ') <> '')
SELECT url, first_value(trim(regexp_replace(path[1], {_SP}, ' ', 'g'), ' ')) OVER (PARTITION BY url ORDER BY chunk_id, block_ord, i) AS title, row_number() OVER (PARTITION BY url ORDER BY chunk_id, block_ord, i)::INT - 1 AS block_ord, kind, text, array_to_string(path, ' > ') AS path, lang FROM o""",
        "check_summary": _ANSWERS + """, s AS (SELECT system, query_id, count(*) AS c, count(*) FILTER (supported) AS ok FROM w GROUP BY ALL), j AS (SELECT b.*, coalesce(c, 0) AS c, coalesce(ok, 0) AS ok FROM b LEFT JOIN s USING (system, query_id))
SELECT system, count(*) AS queries, count(*) FILTER (refused) AS refused, count(*) FILTER (bad) AS malformed, sum(CASE WHEN scored THEN 2 - cited ELSE 0 END)::BIGINT AS dangling_citations, count(*) FILTER (scored) AS answers_scored, sum(c)::BIGINT AS claims, sum(ok)::BIGINT AS supported,
  coalesce(round_even(sum(c) / nullif(count(*) FILTER (scored), 0)::DOUBLE, 2), 0) AS claims_per_answer, coalesce(round_even(sum(ok) / nullif(sum(c), 0)::DOUBLE, 3), 0) AS support_rate, count(*) FILTER (c > 0 AND c = ok) AS answers_fully_supported,
  round(quantile_cont(n / 10e0, 0.5), 9) AS median_model_s, round(quantile_cont(n / 100e0, 0.5), 9) AS median_retrieval_s, round(avg(n), 9) AS mean_prompt_tokens, 5e0 AS mean_completion_tokens FROM j GROUP BY system""",
        "refusal_table": _ANSWERS + """, o AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS i, count(*) OVER () AS n FROM asked), pairs AS (SELECT a.query_id, b.query_id AS donor_id FROM o a JOIN o b ON b.i = (a.i + 20) % a.n),
rel AS (SELECT DISTINCT q.query_id, coalesce(p.page, q.unit) AS page FROM qrels q LEFT JOIN (SELECT DISTINCT url, page FROM pm) p ON p.url = q.unit WHERE grade >= 1),
ctx AS (SELECT DISTINCT r.query_id AS donor_id, page FROM runs r JOIN pm USING (chunk_id) WHERE system = 'bm25' AND rank <= 10),
probe AS (SELECT regexp_extract(query_id, '(\\d+)$', 1)::INT % 3 > 0 AS said, EXISTS (SELECT 1 FROM ctx JOIN rel USING (page) WHERE ctx.donor_id = pairs.donor_id AND rel.query_id = pairs.query_id) AS skipped FROM pairs),
p AS (SELECT count(*) FILTER (NOT skipped) AS probe_pairs, count(*) FILTER (skipped) AS dropped, count(*) FILTER (NOT skipped AND said) AS probe_refused FROM probe)
SELECT system, count(*) FILTER (refused) AS refusals, count(*) AS answers, any_value(probe_pairs) AS probe_pairs, any_value(dropped) AS dropped, any_value(probe_refused) AS probe_refused, round(any_value(coalesce(probe_refused / nullif(probe_pairs, 0)::DOUBLE, 0)), 9) AS correct_refusal FROM b, p GROUP BY system""",
        "route_prompts": f"WITH {_TITLES} SELECT query AS query_id, md5({_prompt(prompts.ROUTE, query='query')}) AS prompt_md5 FROM q",
        "answer_prompts": _CONTEXTS + f", c AS (SELECT query_id, count(*)::INT AS n, {_CONTEXT} AS context FROM j GROUP BY query_id) SELECT query_id, n, md5({_prompt(prompts.ANSWER, context='context', query='query_id', refusal=repr(prompts.REFUSAL))}) AS prompt_md5 FROM c",
        "delta_report": _POOL + ", n AS (SELECT a.query_id, a.category, count(p.url) FILTER (j.url IS NULL) AS n_new, count(j.url) AS n_old FROM asked a LEFT JOIN pooled p ON p.query_id = a.query_id LEFT JOIN judged j ON j.query_id = p.query_id AND j.url = p.url GROUP BY ALL) SELECT query_id, category, sum(n_new)::BIGINT AS n_new, sum(n_old)::BIGINT AS n_already_judged, sum(n_new + n_old)::BIGINT AS pooled, count(*) AS n_queries, count(*) FILTER (n_new = 0) AS n_empty FROM n GROUP BY GROUPING SETS ((query_id, category), ())",
    }
