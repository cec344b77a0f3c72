"""The same queries as SQL for an independent engine (DuckDB)."""

from __future__ import annotations

from mnemospark.functions.text import STOPWORDS
from mnemospark.operators.recall import SECTIONS

from .adapters import BASE, HOUR, KINDS, NOW
from .settings import BATCH, CASES, ENTITY, MIN_MATCH, PROJECT, SAVES_TTL, TOKENS


def quoted(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def raw_tokens(e: str) -> str:
    return f"""list_filter(flatten(list_transform(regexp_extract_all(lower(replace({e}, 'İ', 'i')), '[a-z0-9_./-]+'),
      lambda t: CASE WHEN regexp_matches(t, '[_./-]') THEN list_concat([regexp_replace(t, '^[_./-]+|[_./-]+$', '', 'g')], string_split_regex(t, '[_./-]+')) ELSE [t] END)),
      lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+') AND NOT list_contains({quoted(STOPWORDS)}, t))"""


def ordered(c: str, cap: int) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)[1:{cap}]"


def union(a: str, b: str) -> str:
    return f"list_concat({a}, list_filter({b}, lambda x: NOT list_contains({a}, x)))"


def less(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


TRIM = r"regexp_replace(text, '^[\s\pZ\x0b\x85]+|[\s\pZ\x0b\x85]+$', '', 'g')"
PRELUDE = f"""WITH RECURSIVE labelled AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
mem0 AS (SELECT hash, project_key, arg_min(text, doc_id) AS content, arg_min(lang, doc_id) AS lang, min(doc_id) AS seq, max(doc_id) AS last_id, count(*) AS seen_count,
    CAST(coalesce(sum(quality), 0) AS BIGINT) AS used_count, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS disputed_count
  FROM (SELECT doc_id, text, lang, source AS project_key, sha256(source || chr(0) || lower({TRIM})) AS hash, quality, toxic FROM documents LEFT JOIN labelled USING (doc_id)) GROUP BY hash, project_key),
mem1 AS (SELECT *, substr(hash, 1, 16) AS id, substr(regexp_extract(content, '^[^.\\n]*'), 1, 48) AS title, {quoted(KINDS)}[seq % 5 + 1] AS kind,
    [lang, project_key, lang || '-' || project_key] AS aliases, {BASE} + seq * {HOUR} AS created_at, {BASE} + last_id * {HOUR} AS last_seen_at,
    CASE WHEN used_count > 0 THEN {BASE} + last_id * {HOUR} END AS last_used_at, seq % 37 = 0 AS archived, seq % 41 = 0 AS pinned FROM mem0),
mem2 AS (SELECT *, lower(title) AS title_lc, {raw_tokens("title || ' ' || content")} AS raw, {raw_tokens("array_to_string(aliases, ' ')")} AS raw_a FROM mem1),
mem3 AS (SELECT * EXCLUDE (raw, raw_a), {ordered('raw', 32)} AS own, {ordered('raw_a', 24)} AS of_alias FROM mem2),
memory AS MATERIALIZED (SELECT *, {union('own', 'of_alias')} AS keywords, {less('of_alias', 'own')} AS alias_only,
    lead(hash) OVER (PARTITION BY project_key, title_lc, kind ORDER BY seq) IS NOT NULL AS superseded FROM mem3),
live AS (SELECT * FROM memory WHERE NOT superseded AND NOT archived),
mentions0 AS (SELECT hash, project_key, created_at, seq, unnest(list_concat(list_transform(list_filter(own, lambda t: length(t) >= 9)[1:4], lambda t: {{'name': t, 'etype': 'term'}}), [{{'name': project_key || '/' || lang, 'etype': 'topic'}}])) AS e FROM memory),
mentions AS MATERIALIZED (SELECT DISTINCT hash, project_key || chr(0) || e.name AS entity_key, e.name AS name, e.etype AS etype, project_key, created_at, seq FROM mentions0),
entity0 AS (SELECT entity_key, min(name) AS name, arg_min(etype, seq) AS etype, min(project_key) AS project_key, min(created_at) AS created_at FROM mentions GROUP BY 1),
entity1 AS (SELECT *, lower(name) AS name_lc, {raw_tokens('name')} AS raw FROM entity0),
entity AS MATERIALIZED (SELECT * EXCLUDE (raw), {ordered('raw', 8)} AS tokens FROM entity1),
related AS MATERIALIZED (SELECT a.entity_key AS k1, b.entity_key AS k2, count(DISTINCT a.hash) AS weight FROM mentions a JOIN mentions b ON a.hash = b.hash AND a.entity_key < b.entity_key GROUP BY 1, 2),
basket AS MATERIALIZED (SELECT DISTINCT l_orderkey AS item, l_partkey AS key, c_nationkey AS project FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
edge AS MATERIALIZED (SELECT a.key AS k1, b.key AS k2, count(*) AS weight FROM basket a JOIN basket b ON a.item = b.item AND a.key < b.key GROUP BY 1, 2),
edges2 AS (SELECT k1 AS a, k2 AS b, weight FROM edge UNION ALL SELECT k2, k1, weight FROM edge),
ev AS (SELECT event_id, user_id AS session, epoch_us(ts) AS us, event_type, CAST(props ->> 'k' AS BIGINT) AS ref FROM events),
lives AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY us, event_id) AS life FROM ev),
current AS (SELECT *, max(life) OVER (PARTITION BY session) AS now FROM lives),
shown AS (SELECT session, ref, us, event_id, CASE WHEN event_type = 'click' THEN 'search' ELSE '' END AS via FROM current WHERE life = now AND event_type IN ('view', 'click')),
verdict AS (SELECT session, ref, CASE WHEN event_type = 'purchase' THEN 'used' ELSE 'wrong' END AS verdict, us // 1000000 AS vat FROM ev WHERE event_type IN ('purchase', 'error')),
turns AS (SELECT conv_id AS session, turn AS line, role, text FROM conversations WHERE role IN ('user', 'assistant')),
n_live AS (SELECT count(*) AS n FROM live)
"""


def scored(tokens, mem: str = "live", min_match: float = 0.0, project: str = "", tag: str = "") -> str:
    """CTEs that end in scored<tag>: the whole scoring, from its definition."""
    t = quoted(tokens)
    f = lambda df, n="n": f"ln(1 + ({n} - greatest({df}, 1) + 0.5) / (greatest({df}, 1) + 0.5))"
    return f""",
q1{tag} AS (SELECT hash, list_filter({t}, lambda x: list_contains(keywords, x)) AS matched, alias_only FROM {mem} WHERE list_has_any(keywords, {t})),
hit{tag} AS (SELECT entity_key, name_lc, list_contains({t}, name_lc) AS is_exact, list_filter(list_distinct({t}), lambda x: list_contains(tokens, x) AND x <> name_lc) AS parts FROM entity
  WHERE list_contains({t}, name_lc) OR len(list_filter({t}, lambda x: list_contains(tokens, x) AND x <> name_lc)) > 0),
em{tag} AS (SELECT hash, entity_key, name_lc, is_exact, parts FROM mentions JOIN hit{tag} USING (entity_key) WHERE hash IN (SELECT hash FROM {mem})),
q2{tag} AS (SELECT hash, count(DISTINCT entity_key) AS hits FROM em{tag} GROUP BY 1),
ex{tag} AS (SELECT DISTINCT hash, name_lc AS term FROM em{tag} WHERE is_exact),
pa{tag} AS (SELECT DISTINCT hash, unnest(parts) AS term FROM em{tag}),
nb{tag} AS (SELECT DISTINCT e.entity_key FROM (SELECT k1 AS a, k2 AS b, weight FROM related UNION ALL SELECT k2, k1, weight FROM related) r JOIN hit{tag} h ON r.a = h.entity_key JOIN entity e ON r.b = e.entity_key
  WHERE weight >= 2 AND NOT list_contains({t}, e.name_lc)),
q3{tag} AS (SELECT hash, count(DISTINCT entity_key) AS hits FROM mentions WHERE entity_key IN (SELECT entity_key FROM nb{tag}) AND hash IN (SELECT hash FROM {mem}) GROUP BY 1),
kw{tag} AS (SELECT hash, unnest(matched) AS term, alias_only FROM q1{tag}),
df_kw{tag} AS (SELECT term, count(*) AS df FROM kw{tag} GROUP BY 1), df_ex{tag} AS (SELECT term, count(*) AS df FROM ex{tag} GROUP BY 1), df_pa{tag} AS (SELECT term, count(*) AS df FROM pa{tag} GROUP BY 1),
dfs{tag} AS (SELECT term, coalesce(a.df, 0) AS kw, coalesce(b.df, 0) AS ex, coalesce(c.df, 0) AS pa FROM df_kw{tag} a FULL JOIN df_ex{tag} b USING (term) FULL JOIN df_pa{tag} c USING (term)),
gain{tag} AS (
  SELECT hash, {f('d.kw')} * CASE WHEN list_contains(alias_only, term) THEN 0.5 ELSE 1 END AS g FROM kw{tag} JOIN dfs{tag} d USING (term), n_live
  UNION ALL SELECT hash, 2 * {f('d.ex')} FROM ex{tag} JOIN dfs{tag} d USING (term), n_live WHERE regexp_matches(term, '[ _./-]')
  UNION ALL SELECT hash, {f('greatest(d.kw, d.pa, d.ex)')} FROM ex{tag} JOIN dfs{tag} d USING (term), n_live WHERE NOT regexp_matches(term, '[ _./-]') AND (hash, term) NOT IN (SELECT hash, term FROM kw{tag})
  UNION ALL SELECT hash, {f('greatest(d.kw, d.pa)')} FROM pa{tag} JOIN dfs{tag} d USING (term), n_live WHERE (hash, term) NOT IN (SELECT hash, term FROM kw{tag})
    AND (hash, term) NOT IN (SELECT hash, term FROM ex{tag} WHERE NOT regexp_matches(term, '[ _./-]'))),
direct{tag} AS (SELECT hash, sum(g) AS direct FROM gain{tag} GROUP BY 1 HAVING sum(g) <> 0),
matched{tag} AS (SELECT hash, direct + 0.25e0 * least(coalesce(q3.hits, 0), 4) AS match FROM direct{tag} LEFT JOIN q3{tag} q3 USING (hash)),
scored{tag} AS (SELECT m.*, round(x.match, 6) AS match, round(x.match + 2 * exp(-greatest(0, ({NOW} - greatest(last_seen_at, coalesce(last_used_at, 0))) / 86400e0) / 14e0)
    + 0.3e0 * ln(1e0 + seen_count) + 0.4e0 * ln(1e0 + used_count) - least(disputed_count, 3) + CASE WHEN project_key = '{project}' AND '{project}' <> '' THEN 1.0 ELSE 0 END, 6) AS score
  FROM matched{tag} x JOIN memory m USING (hash) {f'WHERE round(x.match, 9) >= {min_match}' if min_match else ''})
"""


#: The whole scoring for every text of benchmark, prompt by prompt.
_idf = lambda df: f"ln(1 + (n - greatest({df}, 1) + 0.5) / (greatest({df}, 1) + 0.5))"
ALL_PROMPTS = PRELUDE + f""", ask0 AS (SELECT item_id AS pid, 'src' || item_id % 20 AS project, {raw_tokens('text')} AS raw FROM benchmark),
ask AS MATERIALIZED (SELECT pid, project, {ordered('raw', 32)} AS t FROM ask0),
kw AS MATERIALIZED (SELECT pid, hash, term, list_contains(alias_only, term) AS alias FROM live, (SELECT pid, unnest(t) AS term FROM ask) WHERE list_contains(keywords, term)),
hit AS MATERIALIZED (SELECT pid, entity_key, name_lc, list_contains(t, name_lc) AS is_exact, list_filter(t, lambda x: list_contains(tokens, x) AND x <> name_lc) AS parts FROM entity, ask
  WHERE list_contains(t, name_lc) OR len(list_filter(t, lambda x: list_contains(tokens, x) AND x <> name_lc)) > 0),
em AS MATERIALIZED (SELECT pid, hash, entity_key, name_lc, is_exact, parts FROM mentions JOIN hit USING (entity_key) WHERE hash IN (SELECT hash FROM live)),
ex AS MATERIALIZED (SELECT DISTINCT pid, hash, name_lc AS term FROM em WHERE is_exact),
pa AS MATERIALIZED (SELECT DISTINCT pid, hash, unnest(parts) AS term FROM em),
nb AS (SELECT DISTINCT pid, e.entity_key FROM (SELECT k1 AS a, k2 AS b, weight FROM related UNION ALL SELECT k2, k1, weight FROM related) r JOIN hit h ON r.a = h.entity_key JOIN entity e ON r.b = e.entity_key JOIN ask USING (pid)
  WHERE weight >= 2 AND NOT list_contains(t, e.name_lc)),
q3 AS (SELECT pid, hash, count(DISTINCT entity_key) AS hits FROM mentions JOIN nb USING (entity_key) WHERE hash IN (SELECT hash FROM live) GROUP BY 1, 2),
d1 AS (SELECT pid, term, count(*) AS df FROM kw GROUP BY 1, 2), d2 AS (SELECT pid, term, count(*) AS df FROM ex GROUP BY 1, 2), d3 AS (SELECT pid, term, count(*) AS df FROM pa GROUP BY 1, 2),
dfs AS MATERIALIZED (SELECT pid, term, coalesce(d1.df, 0) AS kw, coalesce(d2.df, 0) AS ex, coalesce(d3.df, 0) AS pa, n FROM d1 FULL JOIN d2 USING (pid, term) FULL JOIN d3 USING (pid, term), n_live),
gain AS (SELECT pid, hash, {_idf('d.kw')} * CASE WHEN alias THEN 0.5 ELSE 1 END AS g FROM kw JOIN dfs d USING (pid, term)
  UNION ALL SELECT pid, hash, 2 * {_idf('d.ex')} FROM ex JOIN dfs d USING (pid, term) WHERE regexp_matches(term, '[ _./-]')
  UNION ALL SELECT pid, hash, {_idf('greatest(d.kw, d.pa, d.ex)')} FROM ex JOIN dfs d USING (pid, term) ANTI JOIN kw USING (pid, hash, term) WHERE NOT regexp_matches(term, '[ _./-]')
  UNION ALL SELECT pid, hash, {_idf('greatest(d.kw, d.pa)')} FROM pa JOIN dfs d USING (pid, term) ANTI JOIN kw USING (pid, hash, term) ANTI JOIN (SELECT * FROM ex WHERE NOT regexp_matches(term, '[ _./-]')) e USING (pid, hash, term)),
direct AS (SELECT pid, hash, sum(g) AS direct FROM gain GROUP BY 1, 2 HAVING sum(g) <> 0),
matched AS (SELECT pid, hash, direct + 0.25e0 * least(coalesce(hits, 0), 4) AS match FROM direct LEFT JOIN q3 USING (pid, hash)),
every AS (SELECT pid, id, round(match, 6) AS match, round(match + 2 * exp(-greatest(0, ({NOW} - greatest(last_seen_at, coalesce(last_used_at, 0))) / 86400e0) / 14e0) + 0.3e0 * ln(1e0 + seen_count) + 0.4e0 * ln(1e0 + used_count)
  - least(disputed_count, 3) + CASE WHEN project_key = project THEN 1.0 ELSE 0 END, 6) AS score FROM matched JOIN memory USING (hash) JOIN ask USING (pid) WHERE round(match, 9) >= {MIN_MATCH})
SELECT pid, id, match, score, row_number() OVER (PARTITION BY pid ORDER BY score DESC, id) AS rank FROM every QUALIFY rank <= 5"""


_top = "SELECT id, title, kind, project_key, match, score FROM scored ORDER BY score DESC, id"
_rules = "pinned DESC, project_key <> '{0}', seen_count DESC, last_seen_at DESC, id".format(PROJECT)
_age = f"CASE WHEN {NOW} - last_seen_at < 90 THEN 'just now' WHEN {NOW} - last_seen_at < 5400 THEN ({NOW} - last_seen_at) // 60 || 'm' WHEN {NOW} - last_seen_at < 129600 THEN ({NOW} - last_seen_at) // 3600 || 'h' ELSE ({NOW} - last_seen_at) // 86400 || 'd' END"
_age = _age.replace("//", "// ")
_line = f"'- [' || kind || '] ' || title || ' (' || {_age} || '): ' || substr(regexp_replace(content, '\\s+', ' ', 'g'), 1, 400)"
_pairs = """, blocks AS (SELECT entity_key FROM mentions GROUP BY 1 HAVING count(DISTINCT hash) BETWEEN 2 AND 30),
pair0 AS (SELECT DISTINCT a.hash AS a, b.hash AS b FROM mentions a JOIN mentions b ON a.entity_key = b.entity_key AND a.hash < b.hash WHERE a.entity_key IN (SELECT entity_key FROM blocks)),
pair AS MATERIALIZED (SELECT a, b, len(list_intersect(x.keywords, y.keywords)) / len(list_distinct(list_concat(x.keywords, y.keywords))) AS jaccard FROM pair0 JOIN memory x ON x.hash = a JOIN memory y ON y.hash = b),
sim AS MATERIALIZED (SELECT a, b, jaccard FROM pair WHERE jaccard >= 0.25)"""
_reach = _pairs + """, both_ AS (SELECT a, b FROM sim UNION SELECT b, a FROM sim),
reach(node, other) AS (SELECT a, b FROM both_ UNION SELECT reach.node, both_.b FROM reach JOIN both_ ON reach.other = both_.a),
label AS (SELECT node, least(node, min(other)) AS label FROM reach GROUP BY 1),
member AS MATERIALIZED (SELECT label, node AS hash, count(*) OVER (PARTITION BY label) AS size FROM label)"""

#: The gate's turns: each starts at the first call that no turn of the last day covers.
_gate = """, calls AS MATERIALIZED (SELECT session, ref, us, event_id, event_type = 'click' AS searched FROM ev WHERE event_type IN ('view', 'click')),
turn(session, ref, began) AS (SELECT session, ref, min(us) FROM calls GROUP BY 1, 2 UNION ALL SELECT t.session, t.ref, (SELECT min(us) FROM calls c WHERE c.session = t.session AND c.ref = t.ref AND c.us > t.began + 86400000000) FROM turn t
  WHERE EXISTS (SELECT 1 FROM calls c WHERE c.session = t.session AND c.ref = t.ref AND c.us > t.began + 86400000000)),
gated AS (SELECT t.session, t.ref, t.began, bool_or(c.searched) AS searched, NOT arg_min(c.searched, (c.us, c.event_id)) AS fired FROM turn t JOIN calls c ON c.session = t.session AND c.ref = t.ref AND c.us BETWEEN t.began AND t.began + 86400000000 GROUP BY 1, 2, 3)
"""

#: A batch over the memories without every tenth, row by row: when each memory is replaced, and which rows count.
SAVED = PRELUDE + rf""", old AS (SELECT * FROM memory WHERE seq % {BATCH} <> 1),
row AS (SELECT m.seq, m.hash, m.id, m.title, m.project_key, m.kind, m.keywords, lower(regexp_replace(m.title, '^[\s\pZ\x0b\x85]+|[\s\pZ\x0b\x85]+$', '', 'g')) AS title_lc, t.hash AS target,
    CASE m.seq % {2 * BATCH} WHEN {BATCH + 1} THEN 'update' WHEN {BATCH + 2} THEN 'noop' ELSE 'add' END AS op FROM memory m LEFT JOIN memory t ON t.seq = m.seq + 2 WHERE m.seq % {BATCH} IN (1, 2)),
made AS (SELECT * FROM row WHERE seq % {BATCH} = 1),
every AS (SELECT hash, project_key, title_lc, kind, -1 AS made, superseded AS was FROM old UNION ALL SELECT hash, project_key, title_lc, kind, seq, false FROM made),
by_title AS (SELECT e.hash, arg_min(m.hash, m.seq) AS newer, min(m.seq) AS at FROM every e JOIN made m ON m.project_key = e.project_key AND m.title_lc = e.title_lc AND m.kind = e.kind AND m.seq > e.made WHERE NOT was GROUP BY 1),
by_id AS (SELECT e.hash, arg_min(r.hash, r.seq) AS newer, min(r.seq) AS at FROM every e JOIN row r ON r.op = 'update' AND r.target = e.hash AND r.seq > e.made WHERE NOT was GROUP BY 1),
gone AS (SELECT hash, CASE WHEN coalesce(t.at <= i.at, i.at IS NULL) THEN t.newer ELSE i.newer END AS newer, CASE WHEN coalesce(t.at <= i.at, i.at IS NULL) THEN t.at ELSE i.at END AS at, NOT coalesce(t.at <= i.at, i.at IS NULL) AS asked
  FROM by_title t FULL JOIN by_id i USING (hash)),
counted AS (SELECT r.*, o.seen_count AS before FROM row r LEFT JOIN old o USING (hash) LEFT JOIN gone g USING (hash) WHERE r.op <> 'noop' OR (NOT o.superseded AND coalesce(r.seq < g.at, true)))
"""
#: The model as saves one after the other leave it: each memory seen once, now; titles are compared without the space around them.
SAVED_NOW = PRELUDE
for _old, _new in (
    ("count(*) AS seen_count", "CAST(1 AS BIGINT) AS seen_count"),
    ("CAST(coalesce(sum(quality), 0) AS BIGINT) AS used_count, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS disputed_count", "CAST(0 AS BIGINT) AS used_count, CAST(0 AS BIGINT) AS disputed_count"),
    (f"{BASE} + last_id * {HOUR} AS last_seen_at", f"{NOW} AS last_seen_at"),
    ("lower(title) AS title_lc", f"lower({TRIM.replace('text', 'title')}) AS title_lc"),
):
    assert _old in SAVED_NOW, _old
    SAVED_NOW = SAVED_NOW.replace(_old, _new)
SQL: dict[str, str] = {
    "tokenize_documents": f"WITH r AS (SELECT doc_id, {raw_tokens('text')} AS raw FROM documents) SELECT doc_id, array_to_string({ordered('raw', 32)}, ' ') AS tokens FROM r",
    "tokenize_pages": f"WITH r AS (SELECT page_id, {raw_tokens('html')} AS raw FROM pages) SELECT page_id, array_to_string({ordered('raw', 32)}, ' ') AS tokens FROM r",
    "memory_hash_dedup": PRELUDE + "SELECT hash, id, seen_count, created_at, last_seen_at FROM memory",
    "memory_keywords": PRELUDE + "SELECT id, array_to_string(keywords, ' ') AS keywords FROM memory",
    "alias_only_tokens": PRELUDE + "SELECT id, array_to_string(alias_only, ' ') AS alias_only FROM memory",
    "live_memory": PRELUDE + "SELECT id, title, kind, project_key FROM live",
    "corpus_count": PRELUDE + "SELECT n FROM n_live",
    "keyword_hits": PRELUDE + scored(TOKENS) + "SELECT substr(hash, 1, 16) AS id, array_to_string(matched, ' ') AS matched FROM q1",
    "document_frequency": PRELUDE + scored(TOKENS) + "SELECT term, df FROM df_kw",
    "idf_table": PRELUDE + scored(TOKENS) + "SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df_kw, n_live",
    "entity_hits_exact_partial": PRELUDE + scored(TOKENS) + """SELECT substr(q2.hash, 1, 16) AS id, hits, coalesce((SELECT string_agg(term, ' ' ORDER BY term) FROM ex WHERE ex.hash = q2.hash), '') AS exact,
  coalesce((SELECT string_agg(term, ' ' ORDER BY term) FROM pa WHERE pa.hash = q2.hash), '') AS partial FROM q2""",
    "related_hits": PRELUDE + scored(TOKENS) + "SELECT substr(hash, 1, 16) AS id, hits FROM q3",
    "keyword_search_topk": PRELUDE + scored(TOKENS) + _top + " LIMIT 10",
    "full_retrieval_scored": PRELUDE + scored(TOKENS, project=PROJECT) + "SELECT id, match, score FROM scored",
    "retrieval_floor": PRELUDE + scored(TOKENS, min_match=MIN_MATCH, project=PROJECT) + "SELECT id, match, score FROM scored",
    "search_page_2": PRELUDE + scored(TOKENS) + _top + " LIMIT 10 OFFSET 10",
    "retrieve_exclude_shown": PRELUDE + scored(TOKENS, min_match=MIN_MATCH) + "SELECT id, match, score FROM scored WHERE seq % 3 <> 0",
    "similar_memories_k12": PRELUDE + scored(CASES[0], min_match=MIN_MATCH) + "SELECT id, match, score FROM scored ORDER BY score DESC, id LIMIT 12",
    "rules_sorted": PRELUDE + f"SELECT id, title, pinned, project_key, seen_count FROM live WHERE kind = 'rule' ORDER BY {_rules} LIMIT 50",
    "session_rules": PRELUDE + f"SELECT id, CASE WHEN pinned THEN 0 WHEN project_key = '{PROJECT}' AND kind = 'rule' THEN 1 WHEN project_key = '{PROJECT}' THEN 2 WHEN kind = 'rule' THEN 3 ELSE 4 END AS group_no FROM live WHERE kind IN ('rule', 'preference')",
    "here_set": PRELUDE + f"SELECT id, pinned OR project_key = '{PROJECT}' OR starts_with(project_key, '{PROJECT}/') OR project_key = 'src7' AS kept FROM live WHERE kind IN ('rule', 'preference')",
    "engine_search": SAVED_NOW + scored(TOKENS, min_match=MIN_MATCH, project=PROJECT) + _top + " LIMIT 50",
    "context_sections": PRELUDE + scored(TOKENS, min_match=MIN_MATCH, project=PROJECT) + f""", one AS (SELECT row_number() OVER w AS place, {_line} AS line, sum(octet_length(encode({_line})) + 1) OVER w + {len(SECTIONS[0]) + 1} AS used_bytes FROM scored WINDOW w AS (ORDER BY score DESC, id)),
one_ AS (SELECT * FROM one WHERE used_bytes <= 3880), u AS (SELECT coalesce(max(used_bytes), 0) AS u FROM one_),
rule AS (SELECT * FROM live WHERE kind = 'rule' ORDER BY {_rules} LIMIT 50),
two AS (SELECT row_number() OVER w AS place, {_line} AS line, u + sum(octet_length(encode({_line})) + 1) OVER w + {len(SECTIONS[1]) + 1} AS used_bytes FROM rule, u WINDOW w AS (ORDER BY {_rules})),
two_ AS (SELECT * FROM two WHERE used_bytes <= 3880)
SELECT 0 AS section, place, line, used_bytes::BIGINT AS used_bytes FROM one_ UNION ALL SELECT 0, 0, '{SECTIONS[0]}', {len(SECTIONS[0]) + 1} WHERE EXISTS (SELECT 1 FROM one_)
UNION ALL SELECT 1, place, line, used_bytes FROM two_ UNION ALL SELECT 1, 0, '{SECTIONS[1]}', u + {len(SECTIONS[1]) + 1} FROM u WHERE EXISTS (SELECT 1 FROM two_)""",
    "standing_lines": PRELUDE + "SELECT row_number() OVER (ORDER BY kind <> 'rule', project_key, seen_count DESC, id) AS place, '- [' || kind || '] ' || title || ' — ' || trim(content, ' ') || CASE WHEN project_key <> '' THEN ' (from ' || regexp_extract(project_key, '([^/]*)/*$', 1) || ')' ELSE '' END AS line FROM live WHERE kind IN ('rule', 'preference') AND pinned",
    "context_block_budget": PRELUDE + scored(TOKENS, min_match=MIN_MATCH, project=PROJECT) + f""", lines AS (SELECT id, score, {_line} AS line FROM scored),
run AS (SELECT id, line, sum(octet_length(encode(line)) + 1) OVER (ORDER BY score DESC, id) AS used_bytes FROM lines) SELECT id, line, CAST(used_bytes AS BIGINT) AS used_bytes FROM run WHERE used_bytes <= 9500 - 120""",
    "summary_lines": PRELUDE + scored(TOKENS) + """, top AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS pos, title, count(*) OVER () AS total FROM scored)
SELECT pos, CASE WHEN length(title) <= 20 THEN title ELSE rtrim(substr(title, 1, 19)) || '…' END AS line FROM top WHERE pos <= 6 UNION ALL SELECT 7, '… ' || (max(total) - 6) || ' more' FROM top HAVING max(total) > 6""",
    "entity_list_mentions": PRELUDE + "SELECT e.name, e.etype, e.project_key, count(m.hash) AS mentions FROM entity e LEFT JOIN mentions m USING (entity_key) GROUP BY ALL ORDER BY mentions DESC, name, project_key LIMIT 50",
    "entity_detail_nodes": PRELUDE + f"SELECT e.name, e.etype, e.project_key, count(m.hash) AS mentions FROM entity e LEFT JOIN mentions m USING (entity_key) WHERE e.name_lc = '{ENTITY}' OR (contains(e.name_lc, '{ENTITY}') AND NOT EXISTS (SELECT 1 FROM entity WHERE name_lc = '{ENTITY}')) GROUP BY ALL ORDER BY mentions DESC, name, project_key LIMIT 20",
    "entity_relations": PRELUDE + f"SELECT e.name AS neighbour, e.project_key, max(weight) AS weight FROM (SELECT k1 AS a, k2 AS b, weight FROM related UNION ALL SELECT k2, k1, weight FROM related) r JOIN entity e ON e.entity_key = r.b WHERE r.a IN (SELECT entity_key FROM entity WHERE name_lc = '{ENTITY}') GROUP BY ALL ORDER BY weight DESC, neighbour, e.project_key LIMIT 50",
    "entity_memories": PRELUDE + f"SELECT id, title, kind, project_key, last_seen_at FROM memory WHERE NOT superseded AND hash IN (SELECT hash FROM mentions JOIN entity USING (entity_key) WHERE name_lc = '{ENTITY}') ORDER BY last_seen_at DESC, id LIMIT 50",
    "entity_names_recent": PRELUDE + f"SELECT name, max(created_at) AS created_at FROM entity WHERE project_key = '{PROJECT}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "project_stats": PRELUDE + ", c AS (SELECT 'src' || c_nationkey % 20 AS project_key FROM customer), p AS (SELECT project_key FROM memory UNION SELECT project_key FROM entity UNION SELECT project_key FROM c) SELECT project_key AS project, (SELECT count(*) FROM memory m WHERE m.project_key = p.project_key) AS memories, (SELECT count(*) FROM entity e WHERE e.project_key = p.project_key) AS entities, (SELECT count(*) FROM c WHERE c.project_key = p.project_key) AS sessions FROM p",
    "cooccurrence_edges": PRELUDE + "SELECT k1, k2, weight FROM edge",
    "hub_entities": PRELUDE + ", d AS (SELECT a AS key, count(*) AS degree FROM edges2 GROUP BY 1), n AS (SELECT key, count(DISTINCT item) AS mentions FROM basket GROUP BY 1) SELECT key, mentions, degree FROM n JOIN d USING (key) ORDER BY degree DESC, mentions DESC, key LIMIT 25",
    "cross_project_entities": PRELUDE + "SELECT key, count(DISTINCT project) AS projects FROM basket GROUP BY 1 HAVING count(DISTINCT project) >= 2",
    "graph_histogram": PRELUDE + "SELECT 'Memory' AS label, count(*) AS n FROM memory UNION ALL SELECT 'Entity', count(*) FROM entity UNION ALL SELECT 'MENTIONS', count(*) FROM mentions UNION ALL SELECT 'RELATED', count(*) FROM related",
    "two_hop_neighbourhood": PRELUDE + ", one AS (SELECT b AS key FROM edges2 WHERE a = 10 AND weight >= 1), two AS (SELECT b AS key FROM one JOIN edges2 ON one.key = a WHERE weight >= 1) SELECT key, min(hops) AS hops FROM (SELECT key, 1 AS hops FROM one UNION ALL SELECT key, 2 FROM two) WHERE key <> 10 GROUP BY 1",
    "supersession_chains": PRELUDE + ", c AS (SELECT id, lead(id) OVER w AS newer, count(*) OVER (PARTITION BY project_key, title_lc, kind) AS length, row_number() OVER (PARTITION BY project_key, title_lc, kind ORDER BY seq DESC) - 1 AS depth FROM memory WINDOW w AS (PARTITION BY project_key, title_lc, kind ORDER BY seq)) SELECT id, newer, depth, length FROM c WHERE length > 1",
    "replacement_heads": PRELUDE + """, e AS (SELECT m.hash AS older, coalesce(lead(m.hash) OVER (PARTITION BY m.project_key, m.title_lc, m.kind ORDER BY m.seq), o.hash) AS newer FROM memory m LEFT JOIN memory o ON o.seq = m.seq + 5 AND m.seq % 3 = 0),
walk(id, head, steps) AS (SELECT older, newer, 1 FROM e WHERE newer IS NOT NULL UNION ALL SELECT id, e.newer, steps + 1 FROM walk JOIN e ON e.older = walk.head WHERE e.newer IS NOT NULL)
SELECT substr(id, 1, 16) AS id, substr(arg_max(head, steps), 1, 16) AS head, max(steps)::BIGINT AS steps FROM walk GROUP BY walk.id""",
    "key_map_plan": """WITH c AS (SELECT *, c_custkey // 10 AS ten, 'ws/' || c_nationkey AS at, 'ws/' || c_nationkey || '/' || c_custkey // 10 AS folder FROM customer),
k AS (SELECT folder || '/' || c_custkey AS key, folder, c_mktsegment AS name, CASE WHEN c_custkey % 7 = 0 THEN 'root/' || c_custkey % 3 END AS root, CASE WHEN c_custkey % 11 = 0 THEN 'hand/' || c_custkey END AS hand,
  CASE WHEN EXISTS (SELECT 1 FROM c t WHERE t.folder = c.folder AND t.c_custkey % 40 < 10) THEN 'ten/' || ten || '/' || c_custkey WHEN c_nationkey % 2 = 0 THEN 'new/' || (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) || '/' || ten || '/' || c_custkey END AS mapped FROM c),
f AS (SELECT folder, min(root) AS r FROM k WHERE root IS NOT NULL GROUP BY 1 HAVING count(DISTINCT root) = 1), n AS (SELECT name, min(root) AS r FROM k WHERE root IS NOT NULL GROUP BY 1 HAVING count(DISTINCT root) = 1)
SELECT key, coalesce(root, hand, mapped, f.r, n.r) AS new_key FROM k LEFT JOIN f USING (folder) LEFT JOIN n USING (name)""",
    "saved_entities": SAVED + "SELECT DISTINCT replace(entity_key, chr(0), '|') AS entity_key, name, m.project_key FROM mentions m WHERE hash IN (SELECT hash FROM old) OR hash IN (SELECT hash FROM row WHERE op <> 'noop')",
    "saved_mentions": SAVED + "SELECT DISTINCT substr(hash, 1, 16) AS id, replace(entity_key, chr(0), '|') AS entity_key FROM mentions WHERE hash IN (SELECT hash FROM old) OR hash IN (SELECT hash FROM row WHERE op <> 'noop')",
    "aliases_added": PRELUDE + f""", a AS (SELECT *, ['alpha', 'beta-x', lang] AS new, {raw_tokens("'alpha beta-x ' || lang")} AS raw_n FROM memory), t AS (SELECT *, {ordered('raw_n', 24)} AS tok FROM a)
SELECT id, array_to_string(CASE WHEN seq % 4 = 0 THEN {union('aliases', 'new')} ELSE aliases END, ' ') AS aliases, array_to_string(CASE WHEN seq % 4 = 0 THEN {union('alias_only', less('tok', 'keywords'))} ELSE alias_only END, ' ') AS alias_only,
  array_to_string(CASE WHEN seq % 4 = 0 THEN {union('keywords', 'tok')} ELSE keywords END, ' ') AS keywords FROM t""",
    "superseded_by_keeper": PRELUDE + "SELECT id, superseded OR (seq % 6 = 0 AND EXISTS (SELECT 1 FROM memory k WHERE k.seq = m.seq + 1)) AS superseded FROM memory m",
    "sessions_touched": PRELUDE + """, e AS (SELECT CAST(session AS VARCHAR) AS id, 'src' || ref % 20 AS project_key, 't/' || event_id AS path, 'w/' || ref AS cwd, ref = 7 AS agent, us * 1000 + event_id % 1000 AS whn, event_type FROM ev),
a AS (SELECT id, arg_max(project_key, whn) AS p, arg_max(path, whn) AS f, arg_max(cwd, whn) AS c, bool_or(agent) AS g, max(whn) AS t FROM e WHERE event_type = 'signup' GROUP BY 1),
b AS (SELECT id, arg_max(project_key, whn) AS p, arg_max(path, whn) AS f, arg_max(cwd, whn) AS c, bool_or(agent) AS g, max(whn) AS t FROM e WHERE event_type IN ('view', 'click') GROUP BY 1)
SELECT id, coalesce(b.p, a.p) AS project_key, coalesce(b.f, a.f) AS path, coalesce(b.c, a.c) AS cwd, coalesce(a.g, false) OR coalesce(b.g, false) AS agent, greatest(a.t, b.t) AS touched_at, CASE WHEN a.id IS NULL THEN 0 ELSE 3 END::BIGINT AS cursor FROM a FULL JOIN b USING (id)""",
    "pinned_flags": PRELUDE + "SELECT id, pinned OR (seq % 5 = 0 AND kind IN ('rule', 'preference')) AS pinned FROM memory",
    "supersede_same_title": PRELUDE + f""", old AS (SELECT * FROM memory WHERE seq % {BATCH} <> 1), batch AS (SELECT * FROM memory WHERE seq % {BATCH} IN (1, 2)),
nxt AS (SELECT hash, id, project_key, title_lc, kind, superseded, seen_count, last_seen_at, CAST(0 AS BIGINT) AS ord, hash IN (SELECT hash FROM batch) AS again FROM old UNION ALL SELECT hash, id, project_key, title_lc, kind, false, 1, {NOW}, seq + 1, false FROM batch WHERE hash NOT IN (SELECT hash FROM old))
SELECT id, seen_count + CASE WHEN again THEN 1 ELSE 0 END AS seen_count, CASE WHEN again THEN {NOW} ELSE last_seen_at END AS last_seen_at,
  superseded OR EXISTS (SELECT 1 FROM nxt b WHERE b.ord > a.ord AND b.project_key = a.project_key AND b.title_lc = a.title_lc AND b.kind = a.kind) AS superseded FROM nxt a""",
    "saved_outcomes": SAVED + "SELECT seq, id, title, kind, before IS NULL AS new, coalesce(before, 0) + 1 AS seen, EXISTS (SELECT 1 FROM gone WHERE asked AND gone.at = counted.seq) AS updated FROM counted",
    "saved_memories": SAVED + f"""SELECT id, title, kind, seen_count + CASE WHEN hash IN (SELECT hash FROM counted) THEN 1 ELSE 0 END AS seen_count,
  CASE WHEN hash IN (SELECT hash FROM counted) THEN {NOW} ELSE last_seen_at END AS last_seen_at, superseded OR hash IN (SELECT hash FROM gone) AS superseded, array_to_string(keywords, ' ') AS keywords FROM old
UNION ALL SELECT id, title, kind, 1, {NOW}, hash IN (SELECT hash FROM gone), array_to_string(keywords, ' ') FROM made""",
    "saved_edges": SAVED + f""", span AS (SELECT hash, min(entity_key) AS lo, max(entity_key) AS hi FROM mentions GROUP BY 1),
pair AS (SELECT a.hash, a.entity_key AS k1, b.entity_key AS k2 FROM mentions a JOIN mentions b ON a.hash = b.hash AND a.entity_key < b.entity_key),
fresh AS (SELECT k1, k2, count(*) AS w, arg_min(CASE WHEN k1 = lo AND k2 = hi AND seq % 3 > 0 THEN 'v' || (seq % 3) ELSE '' END, seq) AS v FROM pair JOIN row USING (hash) JOIN span USING (hash) WHERE op <> 'noop' GROUP BY 1, 2),
was AS (SELECT k1, k2, count(*) AS w FROM pair WHERE hash IN (SELECT hash FROM old) GROUP BY 1, 2)
SELECT replace(k1, chr(0), '|') AS k1, replace(k2, chr(0), '|') AS k2, coalesce(was.w, 0) + coalesce(fresh.w, 0) AS weight, CASE WHEN was.w IS NULL THEN nullif(v, '') END AS verb, CASE WHEN fresh.w IS NULL THEN 0 ELSE {NOW} END AS last_seen_at
  FROM was FULL JOIN fresh USING (k1, k2)""",
    "saved_replacements": SAVED + "SELECT substr(newer, 1, 16) AS newer, substr(hash, 1, 16) AS older FROM gone",
    "supersede_by_target": PRELUDE + "SELECT id, true AS superseded FROM memory WHERE seq % 11 = 3",
    "reobserve": PRELUDE + f"SELECT id, seen_count + CASE WHEN seq % 26 = 0 THEN 2 ELSE 1 END AS seen_count, CAST({NOW} AS BIGINT) AS last_seen_at FROM memory WHERE seq % 13 = 0 AND NOT superseded",
    "feedback_counters": PRELUDE + "SELECT ref, count(*) FILTER (verdict = 'used') AS used, count(*) FILTER (verdict <> 'used') AS disputed, max(vat) FILTER (verdict = 'used') AS last_used FROM verdict GROUP BY 1",
    "injected_counters": PRELUDE + "SELECT ref, count(*) AS injected, max(us // 1000000) AS last_injected FROM ev WHERE event_type IN ('view', 'click') GROUP BY 1",
    "archive_candidates": PRELUDE + f", i AS (SELECT ref, count(*) AS injected FROM ev WHERE event_type IN ('view', 'click') GROUP BY 1) SELECT id, injected FROM live JOIN i ON ref = seq % 100 WHERE injected >= 20 AND used_count = 0 AND last_seen_at < {NOW} - 20 * 86400",
    "reindex_plan": PRELUDE + "SELECT id, len(keywords) - 1 AS stored, len(keywords) AS fresh FROM memory WHERE seq % 9 = 4 AND len(keywords) > 0",
    "near_duplicate_pairs": PRELUDE + _pairs + "SELECT substr(a, 1, 16) AS a, substr(b, 1, 16) AS b, round(jaccard, 6) AS jaccard FROM sim",
    "near_duplicate_clusters": PRELUDE + _reach + "SELECT substr(label, 1, 16) AS label, substr(hash, 1, 16) AS id, size FROM member WHERE size <= 8",
    "majority_project": PRELUDE + _reach + ", c AS (SELECT label, lang, count(*) AS n, max(seq) AS reached FROM member JOIN memory USING (hash) GROUP BY ALL) SELECT substr(label, 1, 16) AS label, first(lang ORDER BY n DESC, reached) AS project FROM c GROUP BY label",
    "canonical_union": PRELUDE + _reach + ", a AS (SELECT label, seq, i, aliases[i] AS alias FROM member JOIN memory USING (hash), (SELECT unnest([1, 2, 3]) AS i) WHERE size <= 8), f AS (SELECT label, alias, min(seq * 10 + i) AS place FROM a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY place) AS k FROM f) SELECT substr(label, 1, 16) AS label, string_agg(alias, ' ' ORDER BY place) AS aliases FROM r WHERE k <= 10 GROUP BY label",
    "repo_key_plan": """WITH k AS (SELECT 'ws/' || c_nationkey || '/' || c_custkey AS key, CAST(c_nationkey AS VARCHAR) AS folder, c_mktsegment AS name, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_nationkey % 3 = 0 THEN 'root/' || c_nationkey ELSE 'root/' || c_mktsegment END END AS root FROM customer),
f AS (SELECT folder, min(root) AS r FROM k WHERE root IS NOT NULL GROUP BY 1 HAVING count(DISTINCT root) = 1), n AS (SELECT name, min(root) AS r FROM k WHERE root IS NOT NULL GROUP BY 1 HAVING count(DISTINCT root) = 1)
SELECT key, coalesce(root, f.r, n.r) AS new_key FROM k LEFT JOIN f USING (folder) LEFT JOIN n USING (name)""",
    "transcript_turns": PRELUDE + "SELECT session, line, role, octet_length(encode(text)) AS bytes FROM turns",
    "transcript_chunk_budget": PRELUDE + """, r AS (SELECT *, sum(octet_length(encode(text))) OVER w AS used, row_number() OVER w AS rn FROM turns WINDOW w AS (PARTITION BY session ORDER BY line)), g AS (SELECT * FROM r WHERE used <= 3000 OR rn = 1),
t AS (SELECT session, max(line) + 1 AS total FROM turns GROUP BY 1), x AS (SELECT session, count(*) AS taken, sum(octet_length(encode(text))) AS bytes, max(line) AS last FROM g GROUP BY 1)
SELECT x.session, taken, CAST(bytes AS BIGINT) AS bytes, coalesce((SELECT min(line) FROM turns u WHERE u.session = x.session AND u.line > x.last), total) AS next, total FROM x JOIN t USING (session)""",
    "last_exchange": PRELUDE + r""", e AS (SELECT session, regexp_replace(coalesce(arg_max(text, line) FILTER (role = 'user' AND text <> ''), '') || chr(10) || coalesce(arg_max(text, line) FILTER (role = 'assistant' AND text <> ''), ''), '^[\s\pZ\x0b\x85]+|[\s\pZ\x0b\x85]+$', '', 'g') AS text FROM turns GROUP BY 1)
SELECT session, CASE WHEN octet_length(encode(text)) <= 4000 THEN text ELSE left(text, (SELECT max(k) FROM range(900, 4001) r(k) WHERE octet_length(encode(left(text, k))) <= 4000)) END AS text FROM e""",
    "delta_chars_plan": PRELUDE + ", d AS (SELECT session, count(*) FILTER (line >= 2) AS n, CAST(coalesce(sum(octet_length(encode(text))) FILTER (line >= 2), 0) AS BIGINT) AS bytes FROM turns GROUP BY 1) SELECT session, n, bytes, CASE WHEN n = 0 THEN 'advance' WHEN bytes < 200 AND session % 5 <> 0 AND session % 7 <> 0 THEN 'defer' ELSE 'extract' END AS plan FROM d",
    "weak_prompt_context_plan": f"WITH u AS (SELECT conv_id AS session, turn, text, {raw_tokens('text')} AS raw FROM conversations WHERE role = 'user') SELECT session, turn, CASE WHEN len(list_distinct(raw)) < 3 THEN 'context_first' ELSE 'retry_on_miss' END AS plan FROM u",
    "debounced_jobs": PRELUDE + ", b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY session ORDER BY us, event_id) <= 2700000000 THEN 0 ELSE 1 END AS new FROM ev), c AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY us, event_id) AS burst FROM b) SELECT session, min(us) AS started, max(us) + 2700000000 AS fires, count(*) AS n FROM c GROUP BY session, burst",
    "shown_log_seen": PRELUDE + "SELECT DISTINCT session, ref FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY us DESC, event_id DESC) AS place FROM shown) WHERE via = '' AND place <= 200",
    "shown_ring_200": PRELUDE + "SELECT session, ref, us, via, place FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY us DESC, event_id DESC) AS place FROM shown) WHERE place <= 200",
    "gate_fire_once": PRELUDE + _gate + "SELECT session, count(*) AS prompts, count(*) FILTER (searched) AS searched, count(*) FILTER (fired) AS fired FROM gated GROUP BY 1",
    "stream_gate": PRELUDE + _gate + "SELECT session, count(*) AS prompts, count(*) FILTER (searched) AS searched, count(*) FILTER (fired) AS fired FROM gated GROUP BY 1",
    "gate_stats_day": PRELUDE + _gate + "SELECT count(*) AS prompts, count(*) FILTER (searched) AS searched, count(*) FILTER (fired) AS fired FROM gated WHERE began >= 1704067200000000 + 5 * 86400000000",
    "stream_debounce": PRELUDE + ", b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY session ORDER BY us, event_id) <= 2700000000 THEN 0 ELSE 1 END AS new FROM ev), c AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY us, event_id) AS burst FROM b) SELECT session, min(us) AS started, max(us) + 2700000000 AS fires, count(*) AS n FROM c GROUP BY session, burst",
    "extraction_validate": r"""WITH r AS (SELECT item_id, trim(substr(text, 1, 30)) AS title, trim(repeat(text, CAST(item_id % 40 + 1 AS BIGINT))) AS content, item_id % 5 = 0 AS away, 'k' || (item_id % 4) AS target,
    ['add', 'update', 'noop'][item_id % 3 + 1] AS asked, ['fact', 'rule', 'fact'][item_id % 3 + 1] AS type,
    list_filter(list_transform(string_split(text, ' '), lambda a: lower(trim(regexp_replace(a, '\s+', ' ', 'g')))), lambda a: a <> '' AND strlen(a) <= 40) AS names FROM benchmark),
o AS (SELECT *, CASE WHEN NOT away AND target IN ('k0', 'k1') THEN asked WHEN asked = 'noop' THEN 'drop' ELSE 'add' END AS op FROM r)
SELECT item_id AS reply_id, unnest([0, 1]) AS pos, title, CASE WHEN strlen(content) <= 1500 THEN strlen(content) ELSE list_max(list_filter(list_transform(range(1, 1501), lambda n: strlen(left(content, n))), lambda b: b <= 1500)) END AS bytes,
  CASE WHEN away THEN 'fact' ELSE type END AS kind, op, CASE WHEN op <> 'add' THEN target END AS target_id, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i)[1:10], ',') AS aliases
  FROM o WHERE op <> 'drop' AND title <> '' AND content <> ''""",
    "memory_targets": PRELUDE + "SELECT id, title, kind, pinned FROM live WHERE contains(lower(title), 'the') ORDER BY title, id LIMIT 20",
    "pin_targets": PRELUDE + "SELECT id, title, kind, pinned FROM live WHERE kind IN ('rule', 'preference') AND contains(lower(title), 'an') ORDER BY title, id LIMIT 20",
    "pinned_listing": PRELUDE + "SELECT id, title, project_key, seen_count FROM live WHERE kind IN ('rule', 'preference') AND pinned",
    "pending_aliases": PRELUDE + "SELECT id FROM live WHERE seq % 3 = 0 AND NOT starts_with(project_key, 'src1')",
    "memory_entities": PRELUDE + "SELECT id, coalesce((SELECT string_agg(DISTINCT name, '|' ORDER BY name) FROM mentions WHERE mentions.hash = live.hash), '') AS entities FROM live",
    "busiest_projects": PRELUDE + f"SELECT project_key AS name, count(*) AS memories FROM memory WHERE project_key <> '{PROJECT}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "skipped_footer": PRELUDE + f", s AS (SELECT kind FROM live WHERE kind IN ('rule', 'preference') AND NOT (pinned OR project_key = '{PROJECT}' OR starts_with(project_key, '{PROJECT}/') OR project_key = 'src7')) SELECT format('… {{}} rules + {{}} preferences from other projects not shown', count(*) FILTER (kind = 'rule'), count(*) FILTER (kind <> 'rule')) AS line FROM s HAVING count(*) > 0",
    "expansion_terms": rf"""WITH b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
n AS (SELECT item_id, lower(w[6]) AS own, list_transform([w[1] || ' ' || w[2], w[3] || '-' || w[4], w[5], w[1] || '_' || w[2], w[3] || ' ' || w[4]], lambda x: trim(regexp_replace(lower(x), '[\s\pZ]+', ' ', 'g'))) AS x, lower(w[1] || '_' || w[2]) AS k1, lower(w[3] || ' ' || w[4]) AS k2 FROM b),
c AS (SELECT item_id, own, [x[1], CASE WHEN NOT regexp_matches(x[1], '[-_/.]') AND replace(x[1], ' ', '_') = k1 THEN k1 END, x[2], CASE WHEN trim(regexp_replace(x[2], '[-_/.]+', ' ', 'g')) = k2 THEN k2 END, x[3]] AS t FROM n),
d AS (SELECT item_id, own, unnest(t) AS term, unnest([1, 2, 3, 4, 5]) AS i FROM c),
e AS (SELECT item_id, term, min(i) AS i FROM d WHERE term IS NOT NULL AND term <> own AND octet_length(encode(term)) >= 2 AND NOT regexp_matches(term, '[\x00-\x1f\x7f-\x9f{{}}`"''\\]') AND len(list_filter(string_split(term, ' '), lambda x: x <> '' AND NOT list_contains({quoted(STOPWORDS)}, x))) > 0 GROUP BY 1, 2)
SELECT b.item_id, coalesce(string_agg(term, '|' ORDER BY i), '') AS terms FROM b LEFT JOIN e USING (item_id) GROUP BY 1""",
    "learned_terms": PRELUDE + f""", top AS (SELECT (SELECT max(seq) FROM memory) + 1 AS n, (SELECT max(item_id) FROM benchmark) + 1 AS items),
placed AS (SELECT session, (ref * 31 + session) % n AS ref, us, event_id, via, items FROM shown, top),
verdict_ AS (SELECT session, (ref * 31 + session) % n AS ref, verdict FROM verdict, top),
s AS (SELECT session, ref, us, event_id, via, b.text AS query, m.title, m.content FROM placed JOIN memory m ON m.seq = ref JOIN benchmark b ON b.item_id = ref % items),
single AS (SELECT DISTINCT session, ref FROM verdict_ v WHERE verdict = 'used' AND EXISTS (SELECT 1 FROM s WHERE s.session = v.session AND s.ref = v.ref AND via = 'search') AND NOT EXISTS (SELECT 1 FROM s WHERE s.session = v.session AND s.ref = v.ref AND via = '')),
pair AS (SELECT DISTINCT session, ref, query, title, content FROM single JOIN s USING (session, ref)),
raw AS (SELECT session, ref, {raw_tokens('query')} AS q, {raw_tokens("title || ' ' || content")} AS have FROM pair),
cut AS (SELECT session, ref, {ordered('q', 24)} AS q, {ordered('have', 200)} AS have FROM raw),
t AS (SELECT session, ref, list_filter(q, lambda x: length(x) >= 3 AND NOT list_contains(have, x))[1:3] AS terms FROM cut)
SELECT session, ref, array_to_string(terms, ' ') AS terms FROM t WHERE len(terms) > 0""",
    "drained_reports": PRELUDE + """, r AS (SELECT session, us // 1000000 AS vat, event_id AS seq, event_id % 5 = 0 AS reported, event_id % 900 AS ms, CASE WHEN event_type = 'error' THEN 'e' || ref ELSE '' END AS error,
  CASE WHEN event_type = 'signup' AND ref % 2 = 0 THEN 'deferred: short' WHEN event_type = 'signup' THEN 'no turns' ELSE '' END AS skipped, CASE WHEN event_type = 'purchase' THEN ref % 4 ELSE 0 END AS n, CASE WHEN event_type = 'purchase' THEN ref % 2 ELSE 0 END AS n_new FROM ev WHERE event_type IN ('purchase', 'error', 'signup')),
k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY vat DESC, seq DESC) AS place FROM r), h AS (SELECT * FROM k WHERE place <= 4 AND NOT reported AND 1704931200 - vat <= 864000)
SELECT session, count(*) AS batches, arg_max(ms, seq) AS ms, CAST(sum(n) AS BIGINT) AS count, CAST(sum(n_new) AS BIGINT) AS new, arg_max(error, seq) FILTER (error <> '') AS error,
  CASE WHEN sum(n) > 0 THEN '' WHEN bool_or(starts_with(skipped, 'deferred')) THEN 'deferred' WHEN bool_or(skipped <> '') THEN 'skipped' ELSE '' END AS status FROM h GROUP BY 1""",
    "transcript_jsonl": "SELECT conv_id AS session, turn AS line, role, CASE WHEN octet_length(encode(text)) <= 6000 THEN octet_length(encode(text)) END AS bytes FROM conversations WHERE role IN ('user', 'assistant') AND (conv_id + turn) % 5 <> 0 AND trim(text) <> ''",
    "cursor_turns": PRELUDE + ", t AS (SELECT session, max(line) + 1 AS total FROM turns GROUP BY 1) SELECT session, line FROM turns JOIN t USING (session) WHERE line >= CASE WHEN session % 3 = 1 AND total >= 2 THEN 2 WHEN session % 3 = 0 AND total >= 99 THEN 99 ELSE 0 END",
    "foreign_home": "SELECT c_nationkey AS key, c_mktsegment AS home FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS p FROM customer GROUP BY 1, 2) WHERE p = 1",
    "message_clips": r"""WITH s AS (SELECT doc_id, text, octet_length(encode(text)) AS n FROM documents),
h AS (SELECT *, CASE WHEN n > 6000 THEN (SELECT max(k) FROM range(900, 4001) r(k) WHERE octet_length(encode(left(text, k))) <= 4000) END AS k FROM s),
t AS (SELECT *, CASE WHEN n > 6000 THEN (SELECT max(j) FROM range(400, 2100) r(j) WHERE octet_length(encode(right(text, j))) <= 6000 - octet_length(encode(left(text, k)))) END AS j FROM h)
SELECT doc_id, md5(CASE WHEN n <= 6000 THEN text ELSE left(text, k) || chr(10) || '…' || chr(10) || right(text, j) END) AS clip, CASE WHEN n >= 1048576 THEN printf('%.1fMB', n / 1048576) WHEN n >= 1024 THEN printf('%.0fKB', n / 1024) ELSE n || 'B' END AS size FROM t""",
    "learned_aliases": PRELUDE + "SELECT DISTINCT session, ref FROM verdict v WHERE verdict = 'used' AND EXISTS (SELECT 1 FROM shown s WHERE s.session = v.session AND s.ref = v.ref AND via = 'search') AND NOT EXISTS (SELECT 1 FROM shown s WHERE s.session = v.session AND s.ref = v.ref AND via = '')",
    "hook_miss_rate": PRELUDE + ", used AS (SELECT DISTINCT session, ref FROM verdict WHERE verdict = 'used'), miss AS (SELECT * FROM used u WHERE EXISTS (SELECT 1 FROM shown s WHERE s.session = u.session AND s.ref = u.ref AND via = 'search') AND NOT EXISTS (SELECT 1 FROM shown s WHERE s.session = u.session AND s.ref = u.ref AND via = '')) SELECT (SELECT count(*) FROM used) AS used, (SELECT count(*) FROM miss) AS search_only, round((SELECT count(*) FROM miss) / nullif((SELECT count(*) FROM used), 0), 6) AS miss_rate",
    "save_log_last4": PRELUDE + "SELECT session, ref, us, place FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY us DESC, event_id DESC) AS place FROM ev WHERE event_type = 'purchase') WHERE place <= 4",
    "sweep_behind": PRELUDE + ", t AS (SELECT session, max(us) AS touched, count(*) AS lines, count(*) FILTER (event_type = 'signup') AS cursor FROM ev GROUP BY 1), n AS (SELECT max(us) + 60000000 AS now FROM ev) SELECT session, cursor, lines, now - touched >= 1800000000 AS final FROM t, n WHERE now - touched BETWEEN 180000000 AND 604800000000 AND lines > cursor",
    "cooldown_table": PRELUDE + ", r AS (SELECT session, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY us DESC, event_id DESC) AS good FROM ev WHERE event_type IN ('error', 'purchase')), n AS (SELECT session, count(*) AS failures FROM r WHERE good = 0 GROUP BY 1) SELECT session, failures, CAST(CASE WHEN failures < 3 THEN 0 ELSE least(1440, 30 * 2 ** least(failures - 3, 6)) END AS BIGINT) AS minutes FROM n",
    "stream_shown_log": PRELUDE + """, gap AS (SELECT *, coalesce(us - lag(us) OVER w > 86400000000, false) AS fresh FROM shown WINDOW w AS (PARTITION BY session ORDER BY us, event_id)),
run AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY us, event_id) AS run, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY session) AS runs FROM gap)
SELECT session, ref, us, via, row_number() OVER (PARTITION BY session ORDER BY us DESC, event_id DESC) AS place FROM run WHERE run = runs QUALIFY place <= 200""",
    "stream_failures": PRELUDE + """, r AS (SELECT session, us, event_id, event_type = 'error' AS failed, lead(us) OVER w AS nxt, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER w AS grp FROM ev WHERE event_type IN ('error', 'purchase') WINDOW w AS (PARTITION BY session ORDER BY us, event_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY session, grp ORDER BY us, event_id) AS n FROM r WHERE failed),
p AS (SELECT *, us + least(1440, 30 * pow(2, least(n - 3, 6)))::BIGINT * 60000000 AS due FROM f WHERE n >= 3)
SELECT session, 'retry' AS kind, us + 60000000 AS due FROM f WHERE n = 1 UNION ALL SELECT session, 'resume', due FROM p WHERE nxt IS NULL OR nxt > due""",
    "stream_save_log": PRELUDE + f""", s AS (SELECT *, event_type = 'view' AS drain FROM ev WHERE event_type IN ('purchase', 'error', 'signup', 'view')),
q AS (SELECT *, sum(CASE WHEN drain THEN 1 ELSE 0 END) OVER w AS drains, sum(CASE WHEN drain THEN 0 ELSE 1 END) OVER w AS reports FROM s WINDOW w AS (PARTITION BY session ORDER BY us, event_id)),
r AS (SELECT session, us, drains, reports, event_id % 900 AS ms, CASE WHEN event_type = 'error' THEN 'e' || ref END AS error, CASE WHEN event_type = 'signup' THEN CASE WHEN ref % 2 = 0 THEN 'deferred' ELSE 'no turns' END END AS skipped,
  CASE WHEN event_type = 'purchase' THEN ref % 4 ELSE 0 END AS n, CASE WHEN event_type = 'purchase' THEN ref % 2 ELSE 0 END AS n_new FROM q WHERE NOT drain)
SELECT q.session, q.event_id, q.us, count(*) AS batches, arg_max(r.ms, r.reports) AS ms, sum(n)::BIGINT AS count, sum(n_new)::BIGINT AS new, arg_max(error, r.reports) FILTER (error IS NOT NULL) AS error,
  CASE WHEN sum(n) > 0 THEN '' WHEN bool_or(skipped = 'deferred') THEN 'deferred' WHEN bool_or(skipped IS NOT NULL) THEN 'skipped' ELSE '' END AS status
FROM q JOIN r ON r.session = q.session AND q.drain AND q.drains = r.drains + 1 AND q.reports - r.reports < 4 AND q.us - r.us <= {SAVES_TTL} GROUP BY ALL""",
    "recall_all_prompts": ALL_PROMPTS,
    "eval_summary": PRELUDE + ", ".join(["", *(scored(c, tag=str(i)).lstrip().lstrip(",").rstrip() for i, c in enumerate(CASES))]) + """, results AS ({0}),
exp AS ({1}),
r AS (SELECT case_id, min(pos) AS rank, count(DISTINCT item) AS found FROM results JOIN exp USING (case_id) WHERE contains(lower(title), lower(item)) GROUP BY 1), w AS (SELECT case_id, count(DISTINCT item) AS wanted FROM exp GROUP BY 1),
s AS (SELECT case_id, coalesce(rank, 0) AS rank, round(coalesce(found, 0) / wanted, 6) AS recall, case_id * 100 AS chars, case_id * 37 % 50 AS ms FROM w LEFT JOIN r USING (case_id))
SELECT CASE WHEN case_id % 2 = 0 THEN 'hook' ELSE 'search' END AS mode, count(*) AS n, round(avg(CASE WHEN rank > 0 THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(CASE WHEN rank > 0 THEN 1 / rank ELSE 0 END), 6) AS mrr, round(avg(recall), 6) AS recall,
  max(chars) AS max_chars, list_sort(list(ms))[(count(*) - 1) // 2 + 1] AS p50_ms, list_sort(list(ms))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95_ms, max(ms) AS max_ms FROM s GROUP BY 1""".format(
        " UNION ALL ".join(f"SELECT {i} AS case_id, title, row_number() OVER (ORDER BY score DESC, id) AS pos FROM scored{i} QUALIFY pos <= 10" for i in range(len(CASES))),
        " UNION ALL ".join(f"SELECT DISTINCT {i} AS case_id, upper(left(title, 6)) AS item FROM live WHERE list_contains(keywords, '{c[0]}') AND seq % 4 = 0" for i, c in enumerate(CASES))),
}
