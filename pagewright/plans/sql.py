"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from ..functions import text as T
from ..functions import vectors as V
from . import fixtures as X


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def trim(x: str) -> str:
    return r"regexp_replace(@, '^[\s]+|[\s]+$', '', 'g')".replace("@", x)


TEXT = "coalesce(text, '')"
SPLIT = r"'[^\p{L}\p{N}_-]+'"
FOLD = f"translate(lower(w), '{T.MARKED}', '{T.PLAIN}')"
TERMS = f"list_filter(list_transform(regexp_split_to_array(@, {SPLIT}), lambda w: {FOLD}), lambda w: length(w) >= 2 AND w NOT IN ({quoted(T.STOP_WORDS)}))"


def terms(x: str) -> str:
    return TERMS.replace("@", x)


PARTS = {
    "pages": "pages_ AS (SELECT conv_id::VARCHAR AS doc_id, (turn + 1)::INT AS page_number, coalesce(text, '') AS text FROM conversations)",
    "punits": f"punits AS (SELECT doc_id || ':p' || page_number AS unit_id, doc_id, 'Página ' || page_number AS title, page_number AS page_start, page_number AS page_end, NULL::VARCHAR AS section_id, t AS text, '0:' || page_number AS offsets FROM (SELECT *, {trim('text')} AS t FROM pages_) WHERE strlen(t) > 20)",
    "secs": "secs AS (SELECT doc_id, 'full-document' AS section_id, 'Document Content' AS title, min(page_number) AS page_start, max(page_number) AS page_end FROM pages_ GROUP BY doc_id)",
    "sunits": """starts AS (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pages_),
sunits AS (SELECT s.doc_id || ':sec:' || section_id AS unit_id, s.doc_id, title, page_start, page_end, section_id, title || chr(10) || string_agg(p.text || chr(10), '' ORDER BY page_number) AS text,
  string_agg(coalesce(before + strlen(title) + 1, 0)::BIGINT || ':' || page_number, ',' ORDER BY page_number) AS offsets FROM secs s JOIN starts p ON p.doc_id = s.doc_id AND p.page_number BETWEEN page_start AND page_end GROUP BY s.doc_id, title, page_start, page_end, section_id)""",
    "units": "units AS (SELECT * FROM sunits UNION ALL SELECT * FROM punits)",
    "tf": f"tf AS (SELECT unit_id, term, count(*) AS tf FROM (SELECT unit_id, unnest({terms('text')}) AS term FROM units) GROUP BY unit_id, term)",
    "lens": "lens AS (SELECT unit_id, sum(tf) AS length FROM tf GROUP BY unit_id)",
    "stats": "stats AS (SELECT count(*) AS total_docs, coalesce(avg(coalesce(length, 0)), 1.0) AS avg_len FROM units LEFT JOIN lens USING (unit_id))",
    "dfs": "dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term)",
    "queries": "queries_ AS (SELECT item_id AS query_id, text AS query FROM benchmark)",
    "off": f"queries_ AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT * FROM (VALUES {X.OFF_TOPIC}) AS v(query_id, query))",
    "qtok": f"qarr AS (SELECT query_id, {terms('query')} AS a FROM queries_), qtok AS (SELECT query_id, unnest(a) AS token, unnest(range(0, len(a))) AS ord FROM qarr)",
    "cands": """absent AS (SELECT DISTINCT token FROM {tokens} WHERE token NOT IN (SELECT term FROM dfs)),
clist AS (SELECT token, list_filter(list_concat([token || 's', CASE WHEN suffix(token, 's') THEN left(token, length(token) - 1) END, CASE WHEN suffix(token, 'es') THEN left(token, length(token) - 2) END,
  CASE WHEN suffix(token, 'ers') THEN left(token, length(token) - 3) || 'e' END, CASE WHEN suffix(token, 'ers') THEN left(token, length(token) - 3) END, CASE WHEN suffix(token, 'er') THEN left(token, length(token) - 2) || 'e' END,
  CASE WHEN suffix(token, 'er') THEN left(token, length(token) - 2) END, CASE WHEN suffix(token, 'ing') THEN left(token, length(token) - 3) || 'e' END, CASE WHEN suffix(token, 'ing') THEN left(token, length(token) - 3) END],
  list_transform(list_filter(range(1, length(token) + 1), lambda i: token[i] = 'n'), lambda i: left(token, i - 1) || 'ñ' || substr(token, i + 1))), lambda c: c IS NOT NULL AND strlen(c) >= 2) AS c FROM absent),
ceach AS (SELECT token, unnest(c) AS form, unnest(range(0, len(c))) AS pos FROM clist),
forms AS (SELECT token, form, df FROM ceach JOIN dfs ON dfs.term = form QUALIFY row_number() OVER (PARTITION BY token ORDER BY df DESC, pos) = 1)""",
    "profile": "profile AS (SELECT query_id, min(ord) AS ord, term, coalesce(any_value(dfs.df), 0) AS df, any_value(ln((total_docs - coalesce(dfs.df, 0) + 0.5) / (coalesce(dfs.df, 0) + 0.5) + 1)) AS idf FROM (SELECT query_id, ord, coalesce(form, token) AS term FROM qtok LEFT JOIN forms USING (token)) LEFT JOIN dfs USING (term), stats GROUP BY query_id, term)",
    "floors": "floors AS (SELECT query_id, count(*) AS n, avg(idf) AS floor FROM profile GROUP BY query_id)",
    "matched": "matched AS (SELECT query_id, unit_id, sum(idf) AS mass, sum(idf * (tf.tf * 2.2) / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * length / avg_len))) AS bm25 FROM profile JOIN tf USING (term) JOIN lens USING (unit_id), stats WHERE df > 0 GROUP BY query_id, unit_id)",
    "admitted": "admitted AS (SELECT m.* FROM matched m JOIN floors USING (query_id) WHERE mass >= floor - abs(floor) * 2.220446049250313e-16 * (n + 1))",
    "raw": "raw AS (SELECT query_id, unit_id, sum(times * ln((total_docs - df + 0.5) / (df + 0.5) + 1) * (tf.tf * 2.2) / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * length / avg_len))) AS score FROM (SELECT query_id, token AS term, count(*) AS times FROM qtok GROUP BY ALL) JOIN tf USING (term) JOIN dfs USING (term) JOIN lens USING (unit_id), stats GROUP BY query_id, unit_id)",
}
INDEX = ["pages", "punits", "secs", "sunits", "units", "tf", "lens", "stats", "dfs"]


def using(parts: list[str], then: str, **fill: str) -> str:
    return "WITH " + ",\n".join(PARTS[p].replace("{tokens}", fill.get("tokens", "qtok")) for p in parts) + "\n" + then


RANKED = "SELECT query_id, unit_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS rank FROM {}) WHERE rank <= 10"
PROFILE = [*INDEX, "queries", "qtok", "cands", "profile"]
OFF = [*INDEX, "off", "qtok", "cands", "profile"]
HITS = [*INDEX, "queries", "qtok", "raw"]
COMPACT = trim(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(@, '[ \t\f\v]+', ' ', 'g'), '([\n\r]) +', '\1', 'g'), '\r', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
PACK = f"""clean AS (SELECT *, {COMPACT.replace("@", 'snippet')} AS text FROM hits WHERE rank <= 5),
sized AS (SELECT *, ceil(strlen(text) / 3.8)::BIGINT AS estimated_tokens FROM clean),
run AS (SELECT *, sum(estimated_tokens) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS running_tokens FROM sized),
kept AS (SELECT *, max((rank > 1 AND running_tokens > {{budget}})::INT) OVER (PARTITION BY query_id) = 1 AS truncated FROM run),
packed AS (SELECT *, '[Doc: ' || doc_id || ' p. ' || snippet_page || CASE WHEN section_id IS NULL THEN '' ELSE ' § ' || section_id END || ']' AS citation FROM kept WHERE rank = 1 OR running_tokens <= {{budget}})"""
MARKDOWN = "shown AS (SELECT query_id, '### Evidencia Recuperada (' || count(*) || ' fragmentos, ~' || max(running_tokens) || ' tokens)' || chr(10) || chr(10) || string_agg('**[' || rank || '] ' || citation || '**' || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || chr(10), '' ORDER BY rank) || CASE WHEN bool_or(truncated) THEN '*(Resultados adicionales omitidos para respetar el presupuesto de contexto)*' || chr(10) ELSE '' END AS markdown FROM packed GROUP BY query_id)"


def packed(then: str, budget: int = 600) -> str:
    return hybrid("", 10).rstrip() + ",\n" + PACK.replace("{budget}", str(budget)) + "\n" + then


#: Subword vectors: the mixed 64-bit FNV-1a hashes of words and their 3- and 4-grams, in 128-bit arithmetic.
BYTES = "list_transform(range(0, (length(hex(f)) // 2)::BIGINT), lambda i: ((strpos('0123456789ABCDEF', substr(hex(f), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(f), 2 * i + 2, 1)) - 1)::UHUGEINT)"
WRAP = "% 18446744073709551616::UHUGEINT"
VECTORS = f"""vwords AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '\\s+')) AS word FROM vtexts) WHERE word <> '' GROUP BY ALL),
known AS (SELECT DISTINCT word FROM vwords),
vparts AS (SELECT word, word AS f, 2.0::DOUBLE AS w FROM known UNION ALL SELECT word, substr(word, i, 3), 1.0 FROM (SELECT word, unnest(range(1, length(word) - 1)) AS i FROM known) UNION ALL SELECT word, substr(word, i, 4), 1.2 FROM (SELECT word, unnest(range(1, length(word) - 2)) AS i FROM known)),
h0 AS (SELECT f, list_reduce(list_prepend({V.FNV_OFFSET}::UHUGEINT, {BYTES}), lambda h, b: (xor(h, b) * {V.FNV_PRIME}::UHUGEINT) {WRAP}) AS h FROM (SELECT DISTINCT f FROM vparts)),
h1 AS (SELECT f, (xor(h, h // 8589934592::UHUGEINT) * {V.FINAL_1}::UHUGEINT) {WRAP} AS h FROM h0),
h2 AS (SELECT f, (xor(h, h // 8589934592::UHUGEINT) * {V.FINAL_2}::UHUGEINT) {WRAP} AS h FROM h1),
h3 AS (SELECT f, xor(h, h // 8589934592::UHUGEINT) AS h FROM h2),
vword AS (SELECT word, (h % {V.DIMENSION}::UHUGEINT)::INT AS bin, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -w ELSE w END) AS v FROM vparts JOIN h3 USING (f) GROUP BY ALL),
vraw AS (SELECT id, bin, sum(n * v) AS v FROM vwords JOIN vword USING (word) GROUP BY ALL),
vec AS (SELECT id, bin, (v / greatest(sqrt(sum(v * v) OVER (PARTITION BY id)), 1e-9))::FLOAT::DOUBLE AS v FROM vraw)"""
FUSED = f"""vtexts AS (SELECT 'u' || unit_id AS id, text FROM units WHERE unit_id IN (SELECT unit_id FROM admitted) UNION ALL SELECT 'q' || query_id, query FROM queries_),
{VECTORS},
sizes AS (SELECT id, sqrt(sum(v * v)) AS size FROM vec GROUP BY id),
dots AS (SELECT query_id, unit_id, sum(a.v * b.v) AS dot FROM admitted JOIN vec a ON a.id = 'q' || query_id JOIN vec b ON b.id = 'u' || unit_id AND b.bin = a.bin GROUP BY ALL),
semantic AS (SELECT query_id, unit_id, greatest(0.0, least(1.0, dot / greatest(a.size * b.size, 1e-9))) AS semantic FROM dots JOIN sizes a ON a.id = 'q' || query_id JOIN sizes b ON b.id = 'u' || unit_id),
fused AS (SELECT *, 0.5 * greatest(0, least(1, bm25 / greatest(max(bm25) OVER (PARTITION BY query_id), 1e-5))) + 0.3 * semantic + 0.2 * structural AS final_score FROM (
  SELECT a.query_id, a.unit_id, a.bm25, coalesce(semantic, 0) AS semantic, least(1.0, 0.7 * len(list_intersect(t, {terms('title')})) / len(t) + CASE WHEN section_id IS NOT NULL THEN 0.3 ELSE 0 END) AS structural
  FROM admitted a JOIN units USING (unit_id) LEFT JOIN semantic USING (query_id, unit_id) JOIN (SELECT query_id, list(DISTINCT term) AS t FROM profile GROUP BY query_id) USING (query_id)))"""
#: The text around the first term, in query order, that the folded text has. Folding keeps the number of characters in these tables (no ligatures, no combining marks).
SNIPPETS = """spots AS (SELECT b.*, text, offsets, page_start, doc_id, title, page_end, section_id, coalesce(list_filter(list_transform(terms, lambda t: strpos(folded, t)), lambda p: p > 0)[1], 0) AS p
  FROM best b JOIN (SELECT *, {fold} AS folded FROM units WHERE unit_id IN (SELECT unit_id FROM best)) USING (unit_id) JOIN (SELECT query_id, list(term ORDER BY ord) AS terms FROM profile GROUP BY query_id) USING (query_id)),
placed AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE strlen(left(text, p - 1)) END AS place FROM spots),
led AS (SELECT *, greatest(0, place - 60) AS lead, coalesce(list_max(list_filter(range(greatest(0, p - 61), greatest(p, 1)), lambda k: strlen(left(text, k)) <= greatest(0, place - 60))), 0) AS k FROM placed),
ends AS (SELECT *, strlen(left(text, k)) AS start, least(lead + 250, strlen(text)) AS until FROM led),
cuts AS (SELECT *, list_min(list_filter(range(0, 312), lambda m: start + strlen(substr(text, k + 1, m)) >= until)) AS m FROM ends),
snippets AS (SELECT *, CASE WHEN start > 0 THEN '... ' ELSE '' END || replace({trim}, chr(10), ' ') || CASE WHEN start + strlen(substr(text, k + 1, m)) < strlen(text) THEN ' ...' ELSE '' END AS snippet,
  coalesce(split_part(list_filter(string_split(offsets, ','), lambda o: split_part(o, ':', 1)::BIGINT <= place)[-1], ':', 2)::INT, page_start) AS snippet_page FROM cuts)""".replace("{fold}", FOLD.replace("lower(w)", "lower(text)")).replace("{trim}", trim("substr(text, k + 1, m)"))


def hybrid(then: str, limit: int) -> str:
    """Fused search: hits(query_id, rank, ...) are the best distinct passages."""
    best = f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, unit_id) AS place_ FROM fused) WHERE place_ <= {4 * limit})"
    firsts = "firsts AS (SELECT * FROM snippets QUALIFY row_number() OVER (PARTITION BY query_id, CASE WHEN snippet = '' THEN chr(1) || unit_id ELSE snippet END ORDER BY place_) = 1)"
    hits = f"hits AS (SELECT * EXCLUDE (text) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place_) AS rank FROM firsts) WHERE rank <= {limit})"
    return using([*PROFILE, "floors", "matched", "admitted"], "").rstrip() + ",\n" + ",\n".join([FUSED, best, SNIPPETS, firsts, hits]) + "\n" + then


LINED = f"""lined AS (SELECT doc_id::VARCHAR AS doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'lines', string_agg(text, chr(10) ORDER BY n) FROM (VALUES {X.LINES}) AS v(n, text)),
larr AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM lined), each AS (SELECT doc_id, unnest(a) AS content, unnest(range(0, len(a))) AS line, len(a) AS total FROM larr), lt AS (SELECT doc_id, line, total, content, {trim('content')} AS t FROM each)"""
HEADINGS = LINED + r""",
ht AS (SELECT *, lower(t) AS low, regexp_extract(t, '^([0-9.]*\.[0-9.]*) ', 1) AS digits, regexp_replace(t, '[^\p{L}]', '', 'g') AS letters FROM lt),
hs AS (SELECT *, CASE
  WHEN t = '' OR strlen(t) > 120 OR (suffix(t, '.') AND NOT suffix(t, '...') AND NOT regexp_matches(left(t, 5), '[0-9]')) OR suffix(t, ',') OR suffix(t, ';') THEN NULL
  WHEN prefix(t, '### ') THEN 3 WHEN prefix(t, '## ') THEN 2 WHEN prefix(t, '# ') THEN 1
  WHEN prefix(low, 'chapter ') OR prefix(low, 'capítulo ') OR prefix(low, 'sección ') THEN 1
  WHEN digits <> '' THEN CASE length(digits) - length(replace(digits, '.', '')) WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END
  WHEN strlen(letters) >= 4 AND regexp_matches(letters, '^\p{Lu}+$') AND strlen(t) <= 60 THEN 2 END AS level FROM ht),
headings AS (SELECT doc_id, line, total, level::INT AS level, CASE WHEN prefix(t, '### ') THEN trim(substr(t, 5)) WHEN prefix(t, '## ') THEN trim(substr(t, 4)) WHEN prefix(t, '# ') THEN trim(substr(t, 3))
  WHEN prefix(low, 'chapter ') OR prefix(low, 'capítulo ') OR prefix(low, 'sección ') THEN t WHEN digits <> '' THEN trim(regexp_replace(t, '^[0-9.]+ ', '')) ELSE t END AS title FROM hs WHERE level IS NOT NULL)"""
SLUG = r"CASE WHEN trim(regexp_replace(lower(@), '[^\p{L}\p{N}]+', '-', 'g'), '-') = '' THEN 'section' ELSE trim(regexp_replace(lower(@), '[^\p{L}\p{N}]+', '-', 'g'), '-') END"
SECTIONS = HEADINGS + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS ord, {SLUG.replace("@", "title")} || '-p1' AS section_id FROM headings),
above AS (SELECT *, max(CASE WHEN level = 1 THEN ord END) OVER w AS o1, max(CASE WHEN level = 2 THEN ord END) OVER w AS o2 FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT a.doc_id, a.ord::INT AS ord, a.section_id, a.title, a.level, 1 AS page_start, 1 AS page_end, p.section_id AS parent_id, p.ord AS up FROM above a LEFT JOIN numbered p ON p.doc_id = a.doc_id AND p.ord = CASE WHEN a.level = 1 THEN NULL WHEN a.level = 2 THEN o1 WHEN o2 IS NOT NULL AND (o1 IS NULL OR o2 > o1) THEN o2 ELSE o1 END),
sections AS (SELECT * FROM found UNION ALL SELECT doc_id, 0, 'full-document', 'Document Content', 1, 1, 1, NULL, NULL FROM lined WHERE doc_id NOT IN (SELECT doc_id FROM found))"""
CELLS = LINED + r""",
ct AS (SELECT doc_id, line, content, CASE
  WHEN t = '' THEN [] WHEN prefix(t, '|') AND suffix(t, '|') AND length(t) - length(replace(t, '|', '')) >= 3 THEN list_transform(string_split(regexp_replace(t, '^\|+|\|+$', '', 'g'), '|'), lambda c: trim(c))
  WHEN contains(t, chr(9)) AND len(list_filter(string_split(t, chr(9)), lambda c: trim(c) <> '')) >= 2 THEN list_filter(list_transform(string_split(t, chr(9)), lambda c: trim(c)), lambda c: c <> '')
  ELSE list_filter(list_transform(regexp_split_to_array(t, ' {2,}'), lambda c: trim(c)), lambda c: c <> '') END AS cells,
  regexp_matches(content, '^[-|+:=\s]+$') AND contains(content, '-') AS rule FROM lt)"""
KINDS = rf"""kinds AS (SELECT doc_id, page_number, text, visible, CASE WHEN w IS NOT NULL AND (visible < 50 OR (visible < 150 AND ((w >= 150 AND h >= 150) OR w * h >= 40000))) THEN 'scanned_image' WHEN visible = 0 THEN 'empty' ELSE 'digital_text' END AS kind FROM (
  SELECT *, length(regexp_replace(coalesce(text, ''), '[\s\x00-\x1f\x7f]', '', 'g')) AS visible FROM (
    SELECT conv_id::VARCHAR AS doc_id, turn + 1 AS page_number, text, NULL::INT AS w, NULL::INT AS h FROM conversations UNION ALL SELECT * FROM (VALUES {X.PAGES}) AS v(doc_id, page_number, text, w, h))))"""
LINKS = r"""larr AS (SELECT page_id, regexp_extract_all(html, 'href\s*=\s*["'']([^"'']*)["'']', 1) AS a FROM pages),
links AS (SELECT page_id, ord, uri, CASE WHEN regexp_matches(uri, '^([A-Za-z][A-Za-z0-9+.-]*:|//)') THEN 'external' ELSE 'internal' END AS kind FROM (SELECT page_id, trim(unnest(a)) AS uri, unnest(range(0, len(a))) AS ord FROM larr) WHERE uri <> '')"""
FORMS = f"""WITH RECURSIVE f AS (SELECT * FROM (VALUES {X.FIELDS}) AS v(field_id, parent_id, name, kind, flags, value)),
walk AS (SELECT field_id, coalesce(name, '') AS fq, kind, flags, value FROM f WHERE parent_id IS NULL
  UNION ALL SELECT f.field_id, CASE WHEN coalesce(f.name, '') = '' THEN w.fq WHEN w.fq = '' THEN f.name ELSE w.fq || '.' || f.name END, coalesce(f.kind, w.kind), coalesce(f.flags, w.flags), f.value FROM f JOIN walk w ON f.parent_id = w.field_id),
leaves AS (SELECT field_id, fq AS fully_qualified_name, CASE WHEN kind = 'Tx' THEN 'text' WHEN kind = 'Btn' AND coalesce(flags, 0) & 65536 <> 0 THEN 'button' WHEN kind = 'Btn' AND coalesce(flags, 0) & 32768 <> 0 THEN 'radio' WHEN kind = 'Btn' THEN 'checkbox' WHEN kind = 'Ch' THEN 'choice' WHEN kind = 'Sig' THEN 'signature' ELSE kind END AS field_type,
  coalesce(flags, 0) & 1 <> 0 AS read_only, coalesce(flags, 0) & 2 <> 0 AS required, value FROM walk WHERE field_id NOT IN (SELECT parent_id FROM f WHERE parent_id IS NOT NULL))
"""
ATTACHED = f"WITH a AS (SELECT * FROM (VALUES {X.ATTACHMENTS}) AS v(doc_id, source, ord, stream_id, id, filename)), d AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, stream_id ORDER BY source, ord) = 1)\n"
FRAGMENTS = f"""f AS (SELECT doc_id, page, ord, x::DOUBLE AS x, y::DOUBLE AS y, width::DOUBLE AS width, height::DOUBLE AS height, text FROM (VALUES {X.FRAGMENTS}) AS v(doc_id, page, ord, x, y, width, height, text)),
ext AS (SELECT doc_id, page, min(x) AS x_min, max(x + width) AS x_max, count(*) AS n FROM f GROUP BY doc_id, page),
narrow AS (SELECT f.*, x_min, x_max, length(text) AS chars, count(*) OVER p AS m, sum(length(text)) OVER p AS total, greatest(1, ceil((x_max - x_min) / 2))::INT AS bins FROM f JOIN ext USING (doc_id, page) WHERE n >= 4 AND x_max - x_min >= 140 AND width <= (x_max - x_min) * 0.55 WINDOW p AS (PARTITION BY f.doc_id, f.page)),
cand AS (SELECT *, greatest(0, floor((x - x_min) / 2))::INT AS a, least(bins, ceil((x + width - x_min) / 2))::INT AS b FROM narrow WHERE m >= 4 AND total >= 15),
taken AS (SELECT DISTINCT doc_id, page, unnest(range(a, b)) AS bin FROM cand),
pg AS (SELECT DISTINCT doc_id, page, bins, x_min, total FROM cand),
inside AS (SELECT doc_id, page, x_min, total, unnest(range(floor(bins * 0.18)::INT, ceil(bins * 0.82)::INT)) AS bin FROM pg),
free AS (SELECT *, bin - row_number() OVER (PARTITION BY doc_id, page ORDER BY bin) AS island FROM inside ANTI JOIN taken USING (doc_id, page, bin)),
bands AS (SELECT doc_id, page, total, x_min + (min(bin) + max(bin) + 1) * 2.0 / 2 AS split_x FROM free GROUP BY doc_id, page, x_min, total, island HAVING max(bin) + 1 - min(bin) >= 6),
splits AS (SELECT b.doc_id, b.page, split_x FROM bands b JOIN cand c ON c.doc_id = b.doc_id AND c.page = b.page GROUP BY b.doc_id, b.page, split_x, b.total
  HAVING sum(CASE WHEN x + width <= split_x THEN chars ELSE 0 END) / b.total >= 0.15 AND sum(CASE WHEN x >= split_x THEN chars ELSE 0 END) / b.total >= 0.15)"""
STORED = "s AS (SELECT coalesce(source, '') AS source, doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents)"

SQL: dict[str, str] = {
    "tokenize_terms": f"SELECT doc_id, len(a)::BIGINT AS n_terms, md5(array_to_string(a, ' ')) AS terms_md5 FROM (SELECT doc_id, {terms(TEXT)} AS a FROM documents)",
    "term_frequency": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({terms(TEXT)}) AS term FROM documents) GROUP BY doc_id, term",
    "token_estimate": "SELECT doc_id, ceil(strlen(coalesce(text, '')) / 3.8)::BIGINT AS tokens FROM documents",
    "corpus_tokens": "SELECT greatest(1, coalesce(sum(ceil(strlen(coalesce(text, '')) / 3.8)::BIGINT), 0))::BIGINT AS corpus_tokens FROM documents",
    "compact_text": f"SELECT doc_id, length(c)::BIGINT AS n_chars, md5(c) AS text_md5 FROM (SELECT doc_id, {COMPACT.replace("@", TEXT)} AS c FROM documents)",
    "slugify": f"SELECT page_id, title, {SLUG.replace("@", "title")} AS slug FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS title FROM pages)",
    "citations": "SELECT conv_id, turn, '[Doc: ' || conv_id || ' p. ' || (turn + 1) || CASE WHEN role = 'assistant' THEN ' § full-document' ELSE '' END || ']' AS citation, '[Doc: ' || conv_id || ', Page: ' || (turn + 1) || CASE WHEN role = 'assistant' THEN ', Section: full-document' ELSE '' END || CASE WHEN turn = 2 THEN ', Offset: 20' ELSE '' END || ']' AS provenance FROM conversations",
    "document_frequency_idf": using(INDEX, "SELECT term, df, round(ln((total_docs - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM dfs, stats"),
    "corpus_stats": using(INDEX, "SELECT total_docs, round(avg_len, 6) AS avg_len FROM stats"),
    "page_units": using(["pages", "punits"], "SELECT unit_id, title, page_start, page_end, strlen(text) AS n_bytes, md5(text) AS text_md5, offsets FROM punits"),
    "section_units": using(["pages", "secs", "sunits"], "SELECT unit_id, title, page_start, page_end, strlen(text) AS n_bytes, md5(text) AS text_md5, offsets FROM sunits"),
    "query_profile": using(PROFILE, "SELECT query_id, ord::INT AS ord, term, df, round(idf, 6) AS idf FROM profile"),
    "corpus_form_resolution": using([*INDEX, "queries", "qtok"], "").rstrip() + ",\nvar AS (SELECT DISTINCT token || e AS token FROM qtok, (VALUES ('s'), ('es'), ('er'), ('ers'), ('ing'), ('')) AS v(e)),\n" + PARTS["cands"].replace("{tokens}", "var") + "\nSELECT token, form, df FROM forms",
    "bm25_search": using([*INDEX, "queries", "qtok", "raw"], RANKED.format("raw")),
    "bm25_search_admitted": using([*PROFILE, "floors", "matched", "admitted", "raw"], RANKED.format("(SELECT raw.* FROM raw SEMI JOIN admitted USING (query_id, unit_id))")),
    "admission": using([*PROFILE, "floors", "matched", "admitted"], "SELECT query_id, unit_id, round(mass, 6) AS mass, round(bm25, 6) AS bm25 FROM admitted"),
    "no_evidence": using([*OFF, "floors", "matched"], """SELECT q.query_id, q.query, coalesce((SELECT string_agg(term, ',' ORDER BY ord) FROM profile p WHERE p.query_id = q.query_id AND df = 0), '') AS absent_terms, round(coalesce(best, 0), 6) AS best_matched_idf, round(coalesce(floor, 0), 6) AS required_idf
FROM queries_ q LEFT JOIN floors USING (query_id) LEFT JOIN (SELECT query_id, max(mass) AS best FROM matched GROUP BY query_id) USING (query_id) WHERE floor IS NULL OR best IS NULL OR best < floor - abs(floor) * 2.220446049250313e-16 * (n + 1)"""),
    "absent_terms": using(OFF, "SELECT query_id, term FROM profile WHERE df = 0"),
    "structural_score": using([*OFF, "floors", "matched", "admitted"], f"SELECT query_id, unit_id, title, round(least(1.0, 0.7 * len(list_intersect(t, {terms('title')})) / len(t) + CASE WHEN section_id IS NULL THEN 0 ELSE 0.3 END), 6) AS score FROM admitted JOIN units USING (unit_id) JOIN (SELECT query_id, list(DISTINCT term) AS t FROM profile GROUP BY query_id) USING (query_id)"),
    "hybrid_search": hybrid("SELECT query_id, rank::INT AS rank, unit_id, doc_id, title, section_id, snippet, snippet_page, round(final_score, 6) AS final_score, round(bm25, 6) AS bm25_score, round(semantic, 6) AS semantic_score, round(structural, 6) AS structural_score FROM hits", 5),
    "snippet_page": using([*PROFILE, "raw"], "").rstrip() + ",\nbest AS (SELECT query_id, unit_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS rank FROM raw) WHERE rank <= 5),\n" + SNIPPETS + "\nSELECT query_id, unit_id, rank, snippet, snippet_page FROM snippets",
    "fused_ranking_given_vectors": using([*PROFILE, "floors", "matched", "admitted"], f""", fused AS (SELECT query_id, unit_id, 0.5 * greatest(0, least(1, bm25 / greatest(max(bm25) OVER (PARTITION BY query_id), 1e-5))) + 0.3 * (((length(unit_id) * 37 + query_id * 11) % 1000) / 1000) + 0.2 * structural AS final_score, structural FROM (
  SELECT a.*, least(1.0, 0.7 * len(list_intersect(t, {terms('title')})) / len(t) + CASE WHEN section_id IS NOT NULL THEN 0.3 ELSE 0 END) AS structural FROM admitted a JOIN units USING (unit_id) JOIN (SELECT query_id, list(DISTINCT term) AS t FROM profile GROUP BY query_id) USING (query_id)))
SELECT query_id, unit_id, rank::INT AS rank, round(final_score, 6) AS final_score, round(structural, 6) AS structural_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, unit_id) AS rank FROM fused) WHERE rank <= 10""").replace("\n, fused", ",\nfused"),
    "vector_cosine_topk": "SELECT query_id, vec_id, round(similarity, 5) AS similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, greatest(0.0, least(1.0, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12))) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 10",
    "evidence_pack": packed("SELECT query_id, rank::INT AS rank, doc_id, estimated_tokens, running_tokens, truncated, md5(text) AS text_md5 FROM packed"),
    "evidence_citations": packed("SELECT query_id, rank::INT AS rank, citation FROM packed"),
    "evidence_markdown": packed("").rstrip() + ",\n" + MARKDOWN + "\nSELECT query_id, md5(markdown) AS markdown_md5 FROM shown",
    "read_pages": using(["pages"], """SELECT doc_id, page_number, md5(head || CASE WHEN used > 1500 THEN substr(text, 1, greatest(0, 1500 - (used - size) - strlen(head))::BIGINT) ELSE text END) AS text_md5, used > 1500 AS truncated FROM (
SELECT *, sum((used > 1500)::INT) OVER (PARTITION BY doc_id ORDER BY page_number) AS n_over FROM (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY page_number) AS used FROM (SELECT *, '--- Página ' || page_number || ' ---' || chr(10) AS head, strlen('--- Página ' || page_number || ' ---' || chr(10)) + strlen(text) AS size FROM pages_ WHERE page_number BETWEEN 2 AND 5))) WHERE n_over <= 1"""),
    "expand_section": using(["pages", "secs"], """, heads AS (SELECT doc_id, section_id, page_start, page_end, '# ' || title || chr(10) || chr(10) || '**Metadatos de Provenance:** Documento: `' || doc_id || '`, Páginas: ' || page_start || '-' || page_end || ', ID: `' || section_id || '`' || chr(10) || chr(10) || '### Contenido:' || chr(10) AS head FROM secs),
sized AS (SELECT h.*, page_number, text, ceil(strlen(text) / 3.8)::BIGINT AS own, ceil(strlen(head) / 3.8)::BIGINT AS begun FROM heads h JOIN pages_ p ON p.doc_id = h.doc_id AND page_number BETWEEN page_start AND page_end),
spent AS (SELECT *, begun + coalesce(sum(own) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM sized),
over AS (SELECT *, used + own > 1500 AS cut, sum((used + own > 1500)::INT) OVER (PARTITION BY doc_id ORDER BY page_number) AS n FROM spent)
SELECT doc_id, section_id, head || string_agg(CASE WHEN cut THEN chr(10) || '--- [Página ' || page_number || ' (Parcial)] ---' || chr(10) || substr(text, 1, floor(greatest(0, 1500 - used) * 3.8)::BIGINT) || chr(10) || chr(10) || '*(Contenido podado por límite de presupuesto de contexto)*' || chr(10)
  ELSE chr(10) || '--- [Página ' || page_number || '] ---' || chr(10) || text END, '' ORDER BY page_number) AS text FROM over WHERE n <= 1 GROUP BY doc_id, section_id, head""").replace("\n, heads", ",\nheads"),
    "heading_detect": f"WITH {HEADINGS}\nSELECT doc_id, line::INT AS line, level, title FROM headings",
    "infer_sections": f"WITH {SECTIONS}\nSELECT doc_id, ord, section_id, title, level, page_start, page_end, parent_id FROM sections",
    "outline_depth": f"WITH {SECTIONS}\nSELECT doc_id, ord, depth, repeat('  ', depth - 1) || '* ' || title || ' (pp. ' || page_start || '-' || page_end || ')' AS line FROM (SELECT *, 1 AS depth FROM sections WHERE parent_id IS NULL UNION ALL SELECT s.*, 2 FROM sections s JOIN sections p ON p.doc_id = s.doc_id AND p.ord = s.up WHERE p.parent_id IS NULL)",
    "section_counts": f"WITH {SECTIONS}\nSELECT doc_id, count(*) AS total_sections FROM sections GROUP BY doc_id",
    "page_end_lead": f"WITH {HEADINGS}\nSELECT doc_id, line::INT AS ord, (line + 1)::INT AS page_start, greatest(line + 1, coalesce(lead(line + 1) OVER (PARTITION BY doc_id ORDER BY line) - 1, total))::INT AS page_end FROM headings",
    "title_page_lookup": using(["pages"], "SELECT w.doc_id, 0 AS ord, min(p.page_number) AS page FROM (SELECT doc_id, lower(string_split(text, ' ')[2]) AS title FROM pages_ WHERE page_number = 2) w JOIN pages_ p ON p.doc_id = w.doc_id AND contains(lower(p.text), title) WHERE strlen(title) > 3 GROUP BY w.doc_id"),
    "table_cells": f"WITH {CELLS}\nSELECT doc_id, line::INT AS line, array_to_string(cells, '¦') AS cells, len(cells)::INT AS n FROM ct WHERE len(cells) BETWEEN 2 AND 8 AND NOT rule",
    "table_blocks": f"WITH {CELLS},\ntb AS (SELECT *, NOT rule AND len(cells) BETWEEN 2 AND 8 AS tabular FROM ct), runs AS (SELECT *, sum((NOT tabular AND NOT rule)::INT) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM tb), "
    "counts AS (SELECT a.doc_id, a.run, a.line, len(b.cells) AS size, count(*) AS n, sum(length(array_to_string(b.cells, ''))) AS chars FROM runs a JOIN runs b ON a.doc_id = b.doc_id AND a.run = b.run AND b.line >= a.line WHERE a.tabular AND b.tabular GROUP BY ALL), "
    "starts AS (SELECT doc_id, run, line, sum(n)::BIGINT AS rows_, max({'n': n, 'size': size}) AS mode, sum(chars) AS chars_ FROM counts GROUP BY ALL)\nSELECT doc_id, line::INT AS first_line, rows_ AS n_rows, mode.size::INT AS n_columns FROM starts WHERE rows_ >= 2 AND mode.n / rows_ >= 0.65 AND chars_ >= 8 QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY line) = 1",
    "page_classify": f"WITH {KINDS}\nSELECT doc_id, page_number, visible, kind FROM kinds",
    "scan_summary": f"WITH {KINDS}\nSELECT doc_id, count(*) AS total_pages, count(*) FILTER (kind = 'scanned_image') AS scanned_pages, count(*) FILTER (kind = 'empty') AS empty_pages, sum(strlen(coalesce(text, '')))::BIGINT AS resident_bytes FROM kinds GROUP BY doc_id",
    "link_extract": f"WITH {LINKS}\nSELECT page_id, ord::INT AS ord, uri, kind FROM links",
    "link_filter": f"WITH {LINKS}\nSELECT page_id, ord::INT AS ord, uri FROM links WHERE kind = 'internal'",
    "link_counts": f"WITH {LINKS}\nSELECT page_id, count(*) AS total_links, count(*) FILTER (kind = 'external') AS external_links, count(*) FILTER (kind = 'internal') AS internal_links FROM links GROUP BY page_id",
    "form_classify": FORMS + "SELECT * FROM leaves",
    "form_filter": FORMS + "SELECT * FROM leaves WHERE trim(value) <> ''",
    "attachment_dedup": ATTACHED + "SELECT * FROM d",
    "attachment_lookup": ATTACHED + "SELECT * FROM d WHERE lower(filename) = 'data.csv' OR lower(id) = 'data.csv' ORDER BY ord LIMIT 1",
    "safe_names": ATTACHED + r"SELECT ord, source, filename, CASE WHEN trim(filename) <> '' AND trim(filename) NOT IN ('.', '..') AND NOT regexp_matches(trim(filename), '[/\\:\x00]') THEN trim(filename) END AS safe FROM a",
    "content_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents",
    "corpus_signature": f"WITH {STORED}\nSELECT sha256(string_agg(doc_id::VARCHAR || chr(0) || content_hash || chr(0), '' ORDER BY doc_id::VARCHAR, content_hash)) AS signature FROM s",
    "store_upsert": f"WITH {STORED}\nSELECT content_hash, doc_id, source FROM s QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id DESC) = 1",
    "list_documents": f"WITH {STORED}\nSELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'memory' ELSE 'disk' END AS origin FROM s ORDER BY 1",
    "gutter_detect": f"WITH {FRAGMENTS}\nSELECT doc_id, page, split_x FROM splits",
    "column_order": f"""WITH {FRAGMENTS},
wide AS (SELECT f.*, width > greatest(1, x_max - x_min) * 0.55 AS wide, EXISTS (SELECT 1 FROM splits s WHERE s.doc_id = f.doc_id AND s.page = f.page) AS multi, (SELECT count(*) FROM splits s WHERE s.doc_id = f.doc_id AND s.page = f.page AND f.x >= split_x) AS c FROM f JOIN ext USING (doc_id, page)),
y AS (SELECT *, max(CASE WHEN NOT wide THEN y + height END) OVER p AS top, min(CASE WHEN NOT wide THEN y END) OVER p AS low FROM wide WINDOW p AS (PARTITION BY doc_id, page)),
parts AS (SELECT *, CASE WHEN NOT multi OR NOT wide THEN 1 WHEN y >= top - 5 THEN 0 WHEN y <= low + 5 THEN 2 ELSE 1 END AS part FROM y)
SELECT doc_id, page, ord, part, CASE WHEN part = 1 AND multi THEN c ELSE 0 END::INT AS "column" FROM parts""",
    "fragment_width": """SELECT doc_id, round(greatest(2.0, coalesce(list_sum(list_transform(regexp_extract_all(text, '(?s).'), lambda c: CASE WHEN c = ' ' THEN 0.25 WHEN c IN ('.', ',', ':', ';', '!', '?', '''', '"', '|') THEN 0.22 WHEN c IN ('i', 'l', 'j', 't', 'I', 'f') THEN 0.28 WHEN c IN ('r', 's') THEN 0.38 WHEN c IN ('m', 'w', 'M', 'W') THEN 0.72 WHEN c BETWEEN 'A' AND 'Z' THEN 0.60 ELSE 0.48 END::DOUBLE)), 0) * 11.0), 6) AS width FROM documents""",
    "bench_summary": packed("", 1000).rstrip() + ",\n" + MARKDOWN + """,
measured AS (SELECT q.query_id, ceil(strlen(coalesce(markdown, '')) / 3.8)::BIGINT AS tokens, list_slice(string_split(query, ' '), 2, 5) AS concepts, coalesce(markdown, '') AS text FROM queries_ q LEFT JOIN shown USING (query_id)),
rated AS (SELECT *, (1 - least(1.0, tokens / (SELECT greatest(1, sum(ceil(strlen(text) / 3.8)::BIGINT)) FROM pages_))) * 100 AS reduction, CASE WHEN len(concepts) = 0 THEN 1.0 ELSE len(list_filter(concepts, lambda c: contains(lower(text), lower(c)))) / len(concepts) END AS recall, contains(text, '[Source:') OR contains(text, 'p.') OR contains(text, 'Página') AS cited FROM measured)
SELECT count(*) AS questions, count(*) FILTER (reduction >= 50 AND recall >= 0.33 AND cited) AS passed, round(avg(reduction), 4) AS average_reduction, round(avg(recall), 4) AS average_recall, round(avg(tokens), 4) AS average_tokens FROM rated""",
    "labelled_eval": using([*INDEX, "queries", "qtok", "raw"], """, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS rank FROM raw),
hits AS (SELECT query_id, coalesce(try_cast(regexp_extract(unit_id, ':p(\\d+)$', 1) AS INT), 1) AS page FROM ranked WHERE rank <= 3),
known AS (SELECT query_id, query_id % 5 <> 0 AS answerable, query_id % 2 = 0 AS paraphrased FROM queries_ WHERE query_id % 5 = 0 OR (query_id % 60)::VARCHAR IN (SELECT doc_id FROM pages_)),
each AS (SELECT k.*, coalesce((SELECT bool_or(page BETWEEN 2 AND 4) FROM hits h WHERE h.query_id = k.query_id AND answerable), false) AS found, EXISTS (SELECT 1 FROM hits h WHERE h.query_id = k.query_id) AS got FROM known k)
SELECT count(*) FILTER (answerable) AS answerable, count(*) FILTER (answerable AND found) AS found, count(*) FILTER (answerable AND found AND paraphrased) AS found_paraphrased, count(*) FILTER (answerable AND NOT got) AS wrongly_refused, count(*) FILTER (NOT answerable) AS unanswerable, count(*) FILTER (NOT answerable AND NOT got) AS rightly_refused FROM each""").replace("\n, ranked", ",\nranked"),
    "label_quality": "SELECT count(*) FILTER (s >= 1 AND quality = 1) AS tp, count(*) FILTER (s >= 1 AND quality <> 1) AS fp, count(*) FILTER (s < 1 AND quality = 1) AS fn, count(*) FILTER (s < 1 AND quality <> 1) AS tn FROM (SELECT quality, length(text) - length(replace(text, '|', '')) AS s FROM documents JOIN labels USING (doc_id))",
}
