"""DuckDB SQL with the same rows as the catalogue's queries."""

from __future__ import annotations

from ..functions.columns import TYPES
from ..functions.terms import COVER, FIELDS, RARE, least_variants, parse, variants
from .catalogue import AND, CROSSING, LONG, PHRASE, PHRASINGS, RARE_PART, RARE_WORDS, RELAXED

DOCS = """SELECT doc_id, concat_ws('/', source, lang, 'doc-' || doc_id || '.txt') AS path, 0 AS sec_no, CAST(1 AS BIGINT) AS line, substr(string_split(text, chr(10))[1], 1, 60) AS heading, text AS content,
  substr(trim(string_split(text, chr(10))[1]), 1, 80) AS title, [lang, source] AS tags FROM documents"""
CONVERSATIONS = "SELECT 'conv/' || conv_id || '.md' AS path, turn AS sec_no, turn AS line, role AS heading, text AS content, 'conv-' || conv_id AS title, []::VARCHAR[] AS tags FROM conversations"
LINKS = """SELECT 'pages/' || page_id || '.html' AS src, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS dst FROM pages"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(p)})" for p in parts) + ")"


def _fields(query) -> str:
    says = {
        "title": lambda x: f"contains(t, {_q(x)})", "path": lambda x: f"contains(p, {_q(x)})", "heading": lambda x: f"contains(h, {_q(x)})",
        "tag": lambda x: f"len(list_filter(tags, lambda g: contains(g, {_q(x)}))) > 0", "type": lambda x: "(" + " OR ".join(f"ends_with(p, {_q(e)})" for e in TYPES[x]) + ")",
    }
    return " AND ".join(says[f](x) for f, x in query.fields) or "true"


def search_ctes(scan: str, text: str, tag: str = "") -> str:
    """CTEs that end in ``res{tag}``: (path, line, heading, nmatched, matched_idf, score) of all results, without order or limit."""
    q = parse(text)
    ks, need = range(len(q.plain)), len(q.plain)
    total = lambda xs, zero: " + ".join(xs) or zero
    hits = ", ".join(f"CAST({_any('t', least_variants(t))} OR {_any('p', least_variants(t))} OR {_any('h', least_variants(t))} OR {_any('c', least_variants(t))} AS INT) AS hit{k}" for k, t in enumerate(q.plain))
    counts = [total([f"(length(c) - length(replace(c, {_q(v)}, ''))) // {len(v)}" for v in variants(t)], "0") for t in q.plain]
    pts = ", ".join(f"8 * CAST({_any('t', least_variants(t))} AS INT) + 6 * CAST({_any('p', least_variants(t))} AS INT) + 5 * CAST({_any('h', least_variants(t))} AS INT) + least({counts[k]}, 5) AS pts{k}" for k, t in enumerate(q.plain))
    dfs = ", ".join(f"CAST(sum(CAST({_any('hay', least_variants(t))} AS INT)) AS DOUBLE) AS df{k}" for k, t in enumerate(q.plain))
    idf = ", ".join(f"ln(n / CASE WHEN df{k} > 0 THEN df{k} ELSE 1 END) AS idf{k}" for k in ks)
    score = total([str(float(sum(FIELDS[f] for f, _ in q.fields))) + "::DOUBLE", *(f"CASE WHEN hit{k} = 1 THEN (1 + idf{k}) * pts{k} ELSE 0 END" for k in ks)], "0")
    matched = total([f"CASE WHEN m{k} = 1 THEN idf{k} ELSE 0 END" for k in ks], "0::DOUBLE")
    rare = " OR ".join(f"(m{k} = 1 AND idf{k} > 0 AND idf{k} >= {RARE}::DOUBLE * greatest({', '.join(f'idf{j}' for j in ks)}))" for k in ks) or "false"
    gate = f"matched_idf >= {COVER}::DOUBLE * total OR rare" if q.long else f"nmatched >= {need} OR (nmatched * 2 >= {need} AND {need} >= 2 AND NOT EXISTS (SELECT 1 FROM doc{tag} WHERE nmatched >= {need}))"
    x = tag
    return f"""
s{x} AS (SELECT path, sec_no, line, heading, lower(title) AS t, lower(path) AS p, lower(heading) AS h, lower(content) AS c, tags FROM ({scan})),
hay{x} AS (SELECT path, first(t) || ' ' || first(p) || ' ' || string_agg(h || ' ' || c, ' ' ORDER BY sec_no) AS hay FROM s{x} GROUP BY path),
st{x} AS (SELECT CAST(count(*) AS DOUBLE) AS n{', ' + dfs if dfs else ''} FROM hay{x}),
id{x} AS (SELECT n{', ' + idf if idf else ''} FROM st{x}),
sec{x} AS (SELECT *, {score} AS score FROM (SELECT path, sec_no, line, heading{', ' + hits if hits else ''}{', ' + pts if pts else ''} FROM s{x} WHERE {_fields(q)}), id{x}),
best{x} AS (SELECT path, line, heading, score FROM sec{x} QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, sec_no) = 1),
hit{x} AS (SELECT path{''.join(f', max(hit{k}) AS m{k}' for k in ks)} FROM sec{x} GROUP BY path),
doc{x} AS (SELECT path, line, heading, CAST({total([f'm{k}' for k in ks], '0')} AS BIGINT) AS nmatched, {matched} AS matched_idf, {total([f'idf{k}' for k in ks], '0::DOUBLE')} AS total, {rare} AS rare, score
  FROM best{x} JOIN hit{x} USING (path), id{x} WHERE {need} = 0 OR {total([f'm{k}' for k in ks], '0')} > 0),
res{x} AS (SELECT path, line, heading, nmatched, matched_idf, score FROM doc{x} WHERE {gate})"""


ORDER = "ORDER BY score DESC, matched_idf DESC, nmatched DESC, path"


def search(scan: str, text: str, n: int = 8) -> str:
    return f"WITH {search_ctes(scan, text)}\nSELECT path, line, heading, nmatched, round(CAST(matched_idf AS DOUBLE), 4) AS matched_idf, round(CAST(score AS DOUBLE), 4) AS score FROM res {ORDER} LIMIT {n}"


def _both(*texts: str) -> str:
    ctes = ",".join(search_ctes(DOCS, q, str(k)) for k, q in enumerate(texts))
    return f"WITH {ctes} " + " UNION ALL ".join(f"(SELECT {_q(q)} AS query, path, line, heading, nmatched, round(CAST(matched_idf AS DOUBLE), 4) AS matched_idf, round(CAST(score AS DOUBLE), 4) AS score FROM res{k} {ORDER} LIMIT 8)" for k, q in enumerate(texts))


def _fused() -> str:
    ctes = ",".join(search_ctes(DOCS, q, str(k)) for k, q in enumerate(PHRASINGS))
    votes = " UNION ALL ".join(f"SELECT path, line, heading, row_number() OVER ({ORDER}) - 1 AS rank, {k} AS q FROM res{k}" for k in range(len(PHRASINGS)))
    return f"""WITH {ctes}, votes AS ({votes}), best AS (SELECT path, rank, q, line, heading FROM votes QUALIFY row_number() OVER (PARTITION BY path ORDER BY rank, q) = 1)
SELECT path, round(CAST(sum(1.0::DOUBLE / (60 + votes.rank)) AS DOUBLE), 8) AS rrf, CAST(count(*) AS BIGINT) AS sources, CAST(any_value(best.rank) AS BIGINT) AS best_rank, CAST(any_value(best.q) AS BIGINT) AS best_query, any_value(best.line) AS line, any_value(best.heading) AS heading
FROM votes JOIN best USING (path) GROUP BY path ORDER BY 2 DESC, 4, 5, 1 LIMIT 12"""


_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7))"


def _hybrid() -> str:
    return f"""WITH {search_ctes(DOCS, AND)},
near AS (SELECT path, {_COS} AS cosine FROM embeddings JOIN ({DOCS}) d ON doc_id = vec_id ORDER BY cosine DESC, path DESC LIMIT 20),
b AS (SELECT path, nmatched, matched_idf, score, cosine FROM res LEFT JOIN near USING (path) UNION ALL SELECT path, 0, 0, 10 * cosine, cosine FROM near WHERE path NOT IN (SELECT path FROM res))
SELECT path, CAST(nmatched AS BIGINT) AS nmatched, round(CAST(score AS DOUBLE), 3) AS score, round(CAST(coalesce(cosine, 0) AS DOUBLE), 3) AS cosine, round(CAST(score * (1 + coalesce(cosine, 0)) AS DOUBLE), 3) AS blend
FROM b ORDER BY score * (1 + coalesce(cosine, 0)) DESC, matched_idf DESC, nmatched DESC, path LIMIT 12"""


def _evidence(top: int, k: int) -> str:
    """CTEs up to ``pick``."""
    q = parse(AND)
    hit = " OR ".join(_any("low", variants(t)) for t in q.plain)
    mass = " + ".join(f"CASE WHEN {_any('low', variants(t))} THEN idf{i} ELSE 0 END" for i, t in enumerate(q.plain))
    return f"""WITH {search_ctes(DOCS, AND)}, top AS (SELECT path FROM res {ORDER} LIMIT {top}),
ln AS (SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(len(string_split(content, chr(10))))) AS ord FROM ({DOCS}) SEMI JOIN top USING (path)),
ev AS (SELECT path, ord, trim(text) AS text, {mass} AS idf FROM (SELECT *, lower(text) AS low FROM ln), id WHERE ({hit}) AND trim(text) <> ''),
one AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY path, text ORDER BY idf DESC, ord) = 1),
pick AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idf DESC, ord) AS place FROM one QUALIFY place <= {k})"""


def _weak() -> str:
    from .catalogue import S

    parts, ctes = [], []
    for k, text in enumerate((AND, RELAXED, LONG, "zzqqxx", "the")):
        q = parse(text)
        ctes.append(search_ctes(DOCS, text, str(k)))
        dead = " OR ".join(f"df{j} = 0" for j in range(len(q.plain)))
        partial = "true" if q.long else f"({len(q.plain)} >= 2 AND NOT EXISTS (SELECT 1 FROM doc{k} WHERE nmatched >= {len(q.plain)}))"
        weak = f"(SELECT {dead} FROM st{k}) OR ({partial} AND NOT {str(q.long).lower()}) OR coalesce(max(score) < {S.WEAK_SCORE}, true)"
        parts.append(f"SELECT {_q(text)} AS query, CAST(count(*) AS BIGINT) AS n_results, {partial} AS partial, {weak} AS weak FROM res{k}")
    return f"WITH {','.join(ctes)}\n" + "\nUNION ALL ".join(parts)


_TOKENS = r"regexp_extract_all(lower({}), '\pL[\pL\pN\pM_]+')"
_WEIGHTS = f"""d AS ({DOCS}),
strong AS (SELECT DISTINCT path, unnest(list_concat({_TOKENS.format('title')}, {_TOKENS.format('heading')})) AS token FROM d),
body AS (SELECT path, token FROM (SELECT path, unnest({_TOKENS.format('content')}) AS token FROM d) GROUP BY ALL HAVING count(*) >= 2),
w AS (SELECT path, token, max(weight) AS weight FROM (SELECT *, 2 AS weight FROM strong UNION ALL SELECT *, 1 FROM body) GROUP BY 1, 2),
f AS (SELECT token, count(*) AS d FROM w GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4),
pr AS (SELECT x.path AS a, y.path AS b, round(CAST(x.weight * y.weight / d AS DOUBLE), 9) AS amount FROM w x JOIN f USING (token) JOIN w y USING (token) WHERE x.path < y.path)"""
_GRAPH = f"""lk AS ({LINKS}), al AS (SELECT 'pages/' || page_id || '.html' AS path, page_id, lower(string_split(regexp_extract(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1), '/')[-1]) AS alias FROM pages),
nm AS (SELECT name, arg_max(path, rank || path) AS target FROM (SELECT CAST(page_id AS VARCHAR) AS name, path, '1' AS rank FROM al UNION ALL SELECT alias, path, '0' FROM al WHERE alias IS NOT NULL) GROUP BY 1),
rs AS (SELECT src, trim(dst) AS dst, target FROM lk LEFT JOIN nm ON name = regexp_replace(lower(string_split(trim(dst), '/')[-1]), '\\.(md|pdf|html|htm|txt|rst|org|adoc|png|jpg|jpeg|gif|webp|svg)$', '')),
cn AS (SELECT src AS a, target AS b FROM rs WHERE target IS NOT NULL AND target <> src UNION SELECT target, src FROM rs WHERE target IS NOT NULL AND target <> src)"""

_NOISE = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
_TITLE, _HEAD = r"(?is)<title\b[^>]*>.*?(?:</title\s*>|\z)", r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>"
_BLOCK = r"(?i)</?(?:p|div|br|li|tr|td|th|ul|ol|table|section|article|header|footer|blockquote|pre|dd|dt|h[1-6])\b[^>]*>"


def _only_lines(x: str) -> str:
    return f"regexp_replace({x}, '[^\\n]', '', 'g')"


def _emptied(x: str, pattern: str) -> str:
    """A text without the hits of a pattern but with their line ends."""
    return f"array_to_string(list_transform(list_zip(string_split_regex({x}, '{pattern}'), regexp_extract_all({x}, '{pattern}')), lambda z: z[1] || coalesce({_only_lines('z[2]')}, '')), '')"


def _characters(x: str) -> str:
    for entity, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {char})"
    return x


def _visible(x: str) -> str:
    plain = _characters(f"regexp_replace(regexp_replace({x}, '{_BLOCK}', chr(10), 'g'), '</?[A-Za-z!?][^>]*>', '', 'g')")
    return f"trim(regexp_replace(array_to_string(list_transform(string_split({plain}, chr(10)), lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"


_HEADING_TEXT = _characters("regexp_replace(regexp_extract(h[k], '(?is)^<h[1-6]\\b[^>]*>(.*)</h[1-6]\\s*>$', 1), '</?[A-Za-z!?][^>]*>', '', 'g')")
_PAGE_SECTIONS = f"""WITH a AS (SELECT page_id, {_emptied("coalesce(html, '')", _NOISE)} AS x FROM pages), b AS (SELECT page_id, {_emptied('x', _TITLE)} AS page FROM a),
c AS (SELECT page_id, regexp_extract_all(page, '{_HEAD}') AS h, string_split_regex(page, '{_HEAD}') AS p FROM b),
d AS (SELECT page_id, h, p, unnest(range(0, len(h) + 1)) AS k FROM c WHERE len(h) > 0),
e AS (SELECT page_id, k, CASE WHEN k = 0 THEN 1 ELSE length({_only_lines("array_to_string(p[1:k], '') || array_to_string(h[1:k-1], '')")}) + 1 END AS line, CASE WHEN k = 0 THEN 0 ELSE CAST(h[k][3:3] AS INTEGER) END AS level,
  CASE WHEN k = 0 THEN '(intro)' ELSE coalesce(nullif(trim(regexp_replace({_HEADING_TEXT}, '\\s+', ' ', 'g')), ''), '(heading)') END AS heading, {_visible('p[k + 1]')} AS content FROM d)
SELECT page_id, CAST(line AS BIGINT) AS line, CAST(level AS BIGINT) AS level, heading, md5(content) AS content_md5 FROM e WHERE k > 0 OR content <> ''"""

_NOTES = """SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS dir, coalesce(lang, 'none') AS lang, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc-' || doc_id || '.md' AS path FROM documents"""
_SIGNALS = f"""pt AS (SELECT x.path AS a, y.path AS b, round(CAST(x.weight * y.weight / d AS DOUBLE), 9) AS amount, token AS signal FROM w x JOIN f USING (token) JOIN w y USING (token) WHERE x.path < y.path),
rf AS (SELECT DISTINCT path, dst FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS dst FROM pages) JOIN d ON doc_id = page_id),
rk AS (SELECT dst FROM rf GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6),
rp AS (SELECT x.path AS a, y.path AS b, 2.0::DOUBLE AS amount, dst AS signal FROM rf x JOIN rk USING (dst) JOIN rf y USING (dst) WHERE x.path < y.path),
me AS (SELECT path AS own FROM d WHERE doc_id = 0),
fp AS (SELECT least(own, path) AS a, greatest(own, path) AS b, 0::DOUBLE AS amount, NULL AS signal FROM d, me WHERE path <> own AND string_split(path, '/')[1] = string_split(own, '/')[1]),
ln AS (SELECT least(x.path, y.path) AS a, greatest(x.path, y.path) AS b FROM d x JOIN d y ON y.doc_id = x.doc_id + 1),
ev AS (SELECT * FROM (SELECT * FROM pt UNION ALL SELECT * FROM rp UNION ALL SELECT * FROM fp), me WHERE a = own OR b = own)"""

ORACLES = {
    "page_sections": _PAGE_SECTIONS,
    "vault_files": f"SELECT path, title, CAST(len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words, sha256(content) AS sha FROM ({DOCS})",
    "vault_totals": f"SELECT CAST(count(*) AS BIGINT) AS n_files, CAST(sum(len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS n_words FROM ({DOCS})",
    "directory_summary": f"""WITH d AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, path, title FROM ({DOCS})), r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY path) AS r FROM d)
SELECT dir, CAST(count(*) AS BIGINT) AS n, string_agg(title, ' | ' ORDER BY r) FILTER (r <= 4) AS titles FROM r GROUP BY dir""",
    "term_df_idf": f"""WITH h AS (SELECT lower(concat_ws(' ', title, path, heading, content)) AS hay FROM ({DOCS})), t(term, v) AS (VALUES {', '.join(f"({_q(t)}, [{', '.join(map(_q, least_variants(t)))}])" for t in ('schung', 'tioned', 'the', 'queción'))}),
c AS (SELECT term, CAST(count(*) FILTER (len(list_filter(v, lambda x: contains(hay, x))) > 0) AS BIGINT) AS df, count(*) AS n FROM t, h GROUP BY 1)
SELECT term, df, round(ln(CAST(n AS DOUBLE) / CASE WHEN df > 0 THEN df ELSE 1 END), 6) AS idf FROM c""",
    "search_and": search(DOCS, AND), "search_or_fallback": search(DOCS, RELAXED), "search_long_query": search(DOCS, LONG), "search_phrase": search(DOCS, PHRASE),
    "search_fields": search(DOCS, "type:text path:src1 tag:en tioned"), "search_field_title": search(DOCS, "title:the"),
    "search_rollup_sections": search(CONVERSATIONS, "heading:assistant the en"), "search_conversation_phrase": search(CONVERSATIONS, CROSSING, 20), "search_conversations": search(CONVERSATIONS, "tioned schung", 20),
    "search_kept_index": _both(RARE_WORDS, RARE_PART),
    "kept_index_update": f"SELECT path, sha256(content) AS sha, CAST(len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words, CAST(length(content) AS BIGINT) AS n_chars FROM ({DOCS})",
    "search_fused_rrf": _fused(), "search_hybrid": _hybrid(),
    "semsearch_topk": f"SELECT vec_id, round({_COS}, 6) AS cosine FROM embeddings ORDER BY {_COS} DESC, CAST(vec_id AS VARCHAR) DESC LIMIT 10",
    "semsearch_grouped": f"SELECT vec_id, round({_COS}, 6) AS cosine FROM embeddings ORDER BY {_COS} DESC, CAST(vec_id AS VARCHAR) DESC LIMIT 10",
    "evidence_lines": _evidence(8, 5) + "\nSELECT path, ord, text, round(CAST(idf AS DOUBLE), 4) AS idf, CAST(place AS BIGINT) AS place FROM pick",
    "snippet_blocks": _evidence(3, 8) + """, nr AS (SELECT DISTINCT path, unnest(range(ord - 2, ord + 3)) AS ord FROM pick), kp AS (SELECT path, ord, rtrim(text) AS text, ord - row_number() OVER (PARTITION BY path ORDER BY ord) AS g FROM ln JOIN nr USING (path, ord))
SELECT path, first, text FROM (SELECT path, CAST(min(ord) AS BIGINT) AS first, trim(string_agg(text, chr(10) ORDER BY ord), chr(10)) AS text FROM kp GROUP BY path, g) WHERE text <> ''""",
    "weak_signal": _weak(),
    "token_df": f"SELECT token, CAST(count(DISTINCT path) AS BIGINT) AS df FROM (SELECT path, unnest({_TOKENS.format('content')}) AS token FROM ({DOCS})) GROUP BY 1 HAVING df BETWEEN 2 AND 4",
    "suggest_shared_terms": f"WITH {_WEIGHTS} SELECT a, b, round(sum(amount), 6) AS score, CAST(count(*) AS BIGINT) AS n_words FROM pr GROUP BY 1, 2",
    "suggest_directory": f"""WITH d AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM ({DOCS})), p AS (SELECT dir, string_split(dir, '/')[1] AS above, count(*) AS n FROM d GROUP BY ALL)
SELECT above, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS same, CAST((sum(n) * sum(n) - sum(n * n)) // 2 AS BIGINT) AS sibling FROM p GROUP BY 1""",
    "suggest_refs": f"""WITH r AS (SELECT DISTINCT src, dst FROM ({LINKS})), k AS (SELECT dst FROM r GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6)
SELECT x.src AS a, y.src AS b, 2.0::DOUBLE * count(*) AS score, CAST(count(*) AS BIGINT) AS n_refs FROM r x JOIN k USING (dst) JOIN r y USING (dst) WHERE x.src < y.src GROUP BY 1, 2""",
    "suggest_ranked": f"""WITH {_WEIGHTS}, s AS (SELECT a, b, sum(amount) AS base FROM pr GROUP BY 1, 2), parts AS (
  SELECT path, unnest(list_distinct(list_filter(string_split_regex(lower(regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '')), '[-_ .]'), lambda x: length(x) >= 2))) AS part FROM d
), pf AS (SELECT part, ln(CAST((SELECT count(*) FROM d) AS DOUBLE) / count(*)) AS w FROM parts GROUP BY 1 HAVING count(*) > 1),
nm AS (SELECT a, b, sum(w) AS names FROM s JOIN parts x ON x.path = a JOIN parts y ON y.path = b AND y.part = x.part JOIN pf ON pf.part = x.part GROUP BY 1, 2),
o AS (SELECT s.*, coalesce(names, 0) AS names, regexp_replace(a, '/[^/]*$', '') AS fa, regexp_replace(b, '/[^/]*$', '') AS fb FROM s LEFT JOIN nm USING (a, b)),
x AS (SELECT a, b, base, names, CASE WHEN fa = fb THEN 'same' WHEN string_split(fa, '/')[1] = string_split(fb, '/')[1] THEN 'sibling' ELSE 'far' END AS dir FROM o),
z AS (SELECT a, b, base + CASE dir WHEN 'same' THEN 4 WHEN 'sibling' THEN 2 ELSE 0 END + 1.5::DOUBLE * names AS score, dir FROM x)
SELECT a, b, round(CAST(score AS DOUBLE), 4) AS score, dir FROM z ORDER BY round(CAST(score AS DOUBLE), 6) DESC, a, b LIMIT 20""",
    "suggest_by_names": r"""WITH d AS (SELECT p_partkey AS k, p_brand AS dir, p_brand || '/' || replace(p_name, ' ', '-') || '-' || (p_partkey % 50) || '-' || p_partkey || '.md' AS path FROM part),
parts AS (SELECT path, unnest(list_distinct(list_filter(string_split_regex(lower(regexp_replace(string_split(path, '/')[-1], '\.[^.]+$', '')), '[-_ .]'), lambda x: length(x) >= 2))) AS part FROM d),
pf AS (SELECT part, ln(CAST((SELECT count(*) FROM d) AS DOUBLE) / count(*)) AS w FROM parts GROUP BY 1 HAVING count(*) > 1),
nm AS (SELECT x.path AS a, y.path AS b, sum(w) AS names FROM parts x JOIN pf USING (part) JOIN parts y ON y.part = x.part AND x.path < y.path GROUP BY 1, 2),
z AS (SELECT x.path AS a, y.path AS b, CASE WHEN x.dir = y.dir THEN 4 ELSE 2 END + 1.5::DOUBLE * coalesce(names, 0) AS score, CASE WHEN x.dir = y.dir THEN 'same' ELSE 'sibling' END AS dir
  FROM d x JOIN d y ON x.path < y.path LEFT JOIN nm ON nm.a = x.path AND nm.b = y.path WHERE abs(x.k - y.k) <> 50)
SELECT a, b, round(CAST(score AS DOUBLE), 4) AS score, dir FROM z ORDER BY round(CAST(score AS DOUBLE), 6) DESC, a, b LIMIT 30""",
    "suggest_for_document": f"""WITH {_WEIGHTS}, {_SIGNALS},
s AS (SELECT a, b, sum(amount) AS base, array_to_string(list_slice(list_sort(list_distinct(list(signal))), 1, 8), ',') AS signals FROM ev ANTI JOIN ln USING (a, b) GROUP BY 1, 2), parts AS (
  SELECT path, unnest(list_distinct(list_filter(string_split_regex(lower(regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '')), '[-_ .]'), lambda x: length(x) >= 2))) AS part FROM d
), pf AS (SELECT part, ln(CAST((SELECT count(*) FROM d) AS DOUBLE) / count(*)) AS w FROM parts GROUP BY 1 HAVING count(*) > 1),
nm AS (SELECT a, b, sum(pf.w) AS names FROM s JOIN parts x ON x.path = a JOIN parts y ON y.path = b AND y.part = x.part JOIN pf ON pf.part = x.part GROUP BY 1, 2),
x AS (SELECT s.*, coalesce(names, 0) AS names, CASE WHEN regexp_replace(a, '/[^/]*$', '') = regexp_replace(b, '/[^/]*$', '') THEN 'same' WHEN string_split(a, '/')[1] = string_split(b, '/')[1] THEN 'sibling' ELSE 'far' END AS dir FROM s LEFT JOIN nm USING (a, b)),
z AS (SELECT a, b, CAST(base + CASE dir WHEN 'same' THEN 4 WHEN 'sibling' THEN 2 ELSE 0 END + 1.5::DOUBLE * names AS DOUBLE) AS score, dir, signals FROM x)
SELECT a, b, round(score, 4) AS score, dir, signals FROM z ORDER BY round(score, 6) DESC, a, b LIMIT 20""",
    "tag_counts": "SELECT tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY 1 ORDER BY n DESC, tag LIMIT 15",
    "link_kinds": f"""WITH n AS ({_NOTES}), l AS (
  SELECT path AS src, 'doc-' || (doc_id + 1) AS dst, 'wiki' AS kind FROM n WHERE doc_id % 3 = 0 UNION ALL SELECT path, dir || '/doc-' || (doc_id + 2) || '.md', 'md' FROM n WHERE doc_id % 5 = 0
  UNION ALL SELECT path, '../../../x.md', 'md' FROM n WHERE doc_id % 5 = 0 UNION ALL SELECT path, dir || '/pics/shot-' || (doc_id % 20) || '.png', 'img' FROM n
  UNION ALL SELECT path, 'src/A' || (doc_id % 50) || '.kt', 'code' FROM n UNION ALL SELECT path, 'REQ-' || (doc_id % 30), 'req' FROM n)
SELECT src, dst, kind, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY ALL""",
    "note_orphans": f"""WITH n AS ({_NOTES}), c AS (SELECT x.path AS a, y.path AS b FROM n x JOIN n y ON y.doc_id = x.doc_id + 1 WHERE x.doc_id % 3 = 0
  UNION ALL SELECT x.path, y.path FROM n x JOIN n y ON y.path = x.dir || '/doc-' || (x.doc_id + 2) || '.md' WHERE x.doc_id % 5 = 0)
SELECT path FROM n WHERE path NOT IN (SELECT a FROM c) AND path NOT IN (SELECT b FROM c)""",
    "image_texts": f"""WITH n AS ({_NOTES}), i AS (SELECT dir || '/pics/shot-' || (doc_id % 20) || '.png' AS path, doc_id % 20 AS k, lang || ' ' || (doc_id % 3) AS alt FROM n)
SELECT path, 'shot-' || k || ' shot ' || k || ' ' || string_agg(DISTINCT alt, ' ' ORDER BY alt) AS content FROM i GROUP BY path, k""",
    "markdown_sections": """WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, len(string_split(coalesce(text, ''), chr(10))) AS k FROM conversations)
SELECT conv_id, CAST(4 + coalesce(sum(k + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line, CAST(turn % 3 + 1 AS BIGINT) AS level, role AS heading, md5(trim(text, chr(10))) AS content_md5 FROM t""",
    "page_titles": """SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')) AS title FROM pages""",
    "page_links": f"SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM ({LINKS}) GROUP BY 1, 2",
    "ref_hubs": f"SELECT dst, CAST(count(DISTINCT src) AS BIGINT) AS n FROM ({LINKS}) GROUP BY 1 HAVING n > 1 ORDER BY n DESC, dst LIMIT 10",
    "broken_links": f"WITH {_GRAPH} SELECT DISTINCT dst AS label, src FROM rs WHERE target IS NULL",
    "backlink_hubs": f"WITH {_GRAPH} SELECT target AS path, CAST(count(*) AS BIGINT) AS n FROM rs WHERE target IS NOT NULL AND target <> src GROUP BY 1",
    "orphans": f"WITH {_GRAPH} SELECT path FROM al WHERE path NOT IN (SELECT a FROM cn)",
    "graph_bfs_hops": """WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT 's0' AS node, 0 AS hops WHERE EXISTS (SELECT 1 FROM g WHERE a = 's0') UNION SELECT b, hops + 1 FROM r JOIN g ON a = node WHERE hops < 8)
SELECT node, CAST(min(hops) AS BIGINT) AS hops FROM r GROUP BY 1""",
    "graph_shortest_path": """WITH RECURSIVE l AS (SELECT l_orderkey, 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem),
e AS (SELECT 'c' || o_custkey AS a, p AS b FROM l JOIN orders ON o_orderkey = l_orderkey UNION SELECT p, s FROM l), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t AS (SELECT 'c' || min(o_custkey) AS a, 'c' || max(o_custkey) AS b FROM orders),
r AS (SELECT b AS node, 0 AS hops FROM t UNION SELECT g.a, hops + 1 FROM r JOIN g ON g.b = node WHERE hops < 8), d AS (SELECT node, min(hops) AS hops FROM r GROUP BY 1),
w AS (SELECT t.a AS node, 0 AS step, d.hops AS todo FROM t JOIN d ON d.node = t.a
UNION ALL SELECT (SELECT min(g.b) FROM g JOIN d ON d.node = g.b WHERE g.a = w.node AND d.hops = w.todo - 1), step + 1, todo - 1 FROM w WHERE todo > 0)
SELECT CAST(step AS BIGINT) AS step, node FROM w""",
    "log_compact": "SELECT user_id, event_type, event_id AS line, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "prune_log": """SELECT event_id AS line, user_id, event_type, value FROM events WHERE event_type <> 'click' OR event_type IS NULL
UNION ALL (SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)""",
    "note_freshness": """SELECT conv_id, bool_and(doc_id IS NOT NULL AND doc_id % 7 <> 0) AS fresh FROM conversations LEFT JOIN documents ON doc_id = conv_id * 3 + turn GROUP BY 1""",
    "edge_freshness": """SELECT a.doc_id AS src, a.doc_id + 1 AS dst, b.doc_id IS NOT NULL AND a.doc_id % 5 <> 0 AND b.doc_id % 5 <> 0 AS fresh FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1""",
    "embed_status": """SELECT CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 0 THEN 'stale' ELSE 'fresh' END AS status, CAST(count(*) AS BIGINT) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "doctor_counters": "SELECT CASE WHEN event_id % 11 = 0 THEN 'malformed' ELSE event_type END AS kind, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1",
    "update_diff": """WITH b AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE md5(text) END AS sha FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id AS path, md5(text) AS sha FROM documents WHERE doc_id % 13 <> 0)
SELECT coalesce(b.path, n.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN b.sha <> n.sha THEN 'changed' ELSE 'unchanged' END AS change FROM b FULL JOIN n USING (path)""",
    "import_relation_mode": """WITH l AS (SELECT least('s' || l_suppkey || '.md', 'p' || l_partkey || '.md') AS src, greatest('s' || l_suppkey || '.md', 'p' || l_partkey || '.md') AS dst, l_returnflag AS relation, 's' || l_suppkey || ' --' || l_returnflag || '→ p' || l_partkey AS why FROM lineitem WHERE l_linestatus = 'O'),
c AS (SELECT src, dst, relation, count(*) AS n FROM l GROUP BY 1, 2, 3), w AS (SELECT src, dst, array_to_string(list_slice(list_sort(list_distinct(list(why))), 1, 3), ' | ') AS rationale FROM l GROUP BY 1, 2)
SELECT src, dst, relation, rationale FROM c JOIN w USING (src, dst) QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY n DESC, relation) = 1""",
    "ext_coverage": """SELECT lower(regexp_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '.(\\.[^.]+)$', 1)) AS ext, CAST(count(*) AS BIGINT) AS n FROM pages GROUP BY 1""",
    "path_functions": r"""WITH p AS (SELECT page_id, replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), chr(92), '/') AS p FROM pages), b AS (SELECT page_id, p, string_split(p, '/')[-1] AS base FROM p),
s AS (SELECT *, CASE WHEN regexp_matches(base, '^.+\.[^.]+$') THEN regexp_replace(base, '\.[^.]+$', '') ELSE base END AS stem FROM b)
SELECT page_id, stem, array_to_string(list_filter(string_split_regex(stem, '[-_.\s]+'), lambda x: x <> ''), ' ') AS words, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(stem), '[-_ .]'), lambda x: length(x) >= 2))), ',') AS parts,
  regexp_replace(lower(base), '\.(md|pdf|html|htm|txt|rst|org|adoc|png|jpg|jpeg|gif|webp|svg)$', '') AS link, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END AS dir,
  lower(regexp_extract(base, '.(\.[^.]+)$', 1)) AS ext FROM s""",
    "path_pairs": f"""WITH d AS (SELECT doc_id, regexp_replace(path, '/[^/]*$', '') AS dir FROM ({DOCS}))
SELECT CASE WHEN a.dir = b.dir THEN 'same' WHEN string_split(a.dir, '/')[1] = string_split(b.dir, '/')[1] THEN 'sibling' ELSE 'far' END AS dir, CAST(count(*) AS BIGINT) AS n FROM d a JOIN d b ON b.doc_id = a.doc_id + 1 GROUP BY 1""",
    "ignore_rules": "SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents WHERE source <> 'src1' AND lang <> 'de' AND NOT (source = 'src2' AND lang = 'en') GROUP BY 1",
    "capped_counts": f"""SELECT path, CAST(least({' + '.join(f"(length(c) - length(replace(c, {_q(v)}, ''))) // {len(v)}" for v in variants('über'))}, 5) AS BIGINT) AS n FROM (SELECT path, lower(content) AS c FROM ({DOCS})) WHERE n > 0""",
    "notes_surfaced": """WITH n AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, bool_and(doc_id IS NOT NULL AND doc_id % 7 <> 0) AS fresh FROM conversations LEFT JOIN (SELECT doc_id FROM documents) ON doc_id = conv_id * 3 + turn GROUP BY 1)
SELECT conv_id, CAST(length(text) AS BIGINT) AS n_chars FROM n WHERE fresh AND contains(lower(text), 'the') AND contains(lower(text), 'en') ORDER BY conv_id DESC LIMIT 3""",
    "log_carried": r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id = 5 THEN 'new/5.md' ELSE 'd/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' END AS p,
  CASE WHEN doc_id % 7 = 0 THEN 'old' WHEN doc_id % 3 = 0 OR doc_id = 5 THEN reverse(md5(text)) ELSE md5(text) END AS s FROM documents)
SELECT 'a' || doc_id AS line, '{"type":"embed", "dim":3,"path": "' || p || '","sha":"' || s || '","vec":[1,2.50]}' AS raw FROM d
UNION ALL SELECT 'b' || doc_id, '{"weight":0.25,"type":"edge","src":"' || p || '","dst":"z.md","rationale":"a \"src\": \"d/5\"","src_sha":"' || s || '","dst_sha":"zz","ok":true}' FROM d""",
    "notes_matched": """WITH n AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1)
SELECT conv_id, CAST(length(text) AS BIGINT) AS n_chars FROM n WHERE contains(lower(text), 'the') AND contains(lower(text), 'en') ORDER BY conv_id DESC LIMIT 3""",
    "plain_text_sections": f"""SELECT path, CAST(0 AS BIGINT) AS sec_no, CAST(1 AS BIGINT) AS line, substr(trim(string_split(content, chr(10))[1]), 1, 60) AS heading, CAST(length(trim(content, chr(10))) AS BIGINT) AS n_chars FROM ({DOCS})""",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
    "name_parts": "SELECT part, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_partkey, unnest(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 2))) AS part FROM part) GROUP BY 1",
}
