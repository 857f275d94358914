"""DuckDB SQL for those training-data queries that SQL can express."""

from lodeframe.llm import warc

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

NEAR_CLASSES = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 1 THEN w
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM w WHERE len(w) > 0),
r AS MATERIALIZED (SELECT g, min(doc_id) AS rep, len(g) AS n, row_number() OVER () AS k FROM s GROUP BY g),
m AS MATERIALIZED (SELECT doc_id, k FROM s JOIN r USING (g)),
e AS (SELECT k, n, unnest(g) AS gram FROM r),
c AS (SELECT a.k AS a, b.k AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS same
      FROM e a JOIN e b ON a.gram = b.gram AND a.k < b.k GROUP BY 1, 2),
p AS MATERIALIZED (SELECT a, b FROM c WHERE same::DOUBLE / (na + nb - same) >= 0.55::DOUBLE),
l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
x AS MATERIALIZED (SELECT a, b FROM l UNION SELECT y.k, z.k FROM m y JOIN m z USING (doc_id) WHERE y.k <> z.k),
t AS (SELECT k AS a, k AS b FROM r UNION SELECT t.a, x.b FROM t JOIN x ON t.b = x.a),
f AS (SELECT t.a AS k, min(r.rep) AS class_id FROM t JOIN r ON t.b = r.k GROUP BY t.a),
d AS (SELECT a AS k, count(*) AS links FROM l GROUP BY a)
SELECT doc_id, coalesce(min(class_id), doc_id) AS class_id, coalesce(sum(links), 0)::BIGINT AS n_links
FROM ids LEFT JOIN m USING (doc_id) LEFT JOIN f USING (k) LEFT JOIN d USING (k) GROUP BY doc_id
"""

FINGERPRINTS = f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
t AS (SELECT rid, unnest(list_distinct({_WORDS})) AS term FROM w WHERE text IS NOT NULL),
f AS (SELECT term FROM t GROUP BY term HAVING count(*) >= 2
      AND count(*) >= 0.002::DOUBLE * (SELECT count(*) FROM documents) AND count(*) <= 0.05::DOUBLE * (SELECT count(*) FROM documents)),
l AS (SELECT term, substr(md5(term || '|1'), 1, 2) < 'c0' AS k1, substr(md5(term || '|2'), 1, 2) < 'c0' AS k2, substr(md5(term || '|3'), 1, 2) < 'c0' AS k3 FROM f),
g AS (SELECT rid, count(*) AS n_terms, md5(string_agg(term, ' ' ORDER BY term)) AS fp_0,
        md5(string_agg(term, ' ' ORDER BY term) FILTER (k1)) AS fp_1,
        md5(string_agg(term, ' ' ORDER BY term) FILTER (k2)) AS fp_2,
        md5(string_agg(term, ' ' ORDER BY term) FILTER (k3)) AS fp_3 FROM t JOIN l USING (term) GROUP BY rid)
SELECT doc_id, coalesce(n_terms, 0)::BIGINT AS n_terms, fp_0, fp_1, fp_2, fp_3 FROM w LEFT JOIN g USING (rid)
"""

CHAT = r"""
WITH RECURSIVE d AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL),
t AS (SELECT *, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + 3 AS tokens,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM d),
s AS (SELECT conv_id, role = 'system' AS has, CASE WHEN role = 'system' THEN tokens ELSE 0 END AS head, text FROM t WHERE k = 1),
r AS (SELECT t.*, k - CASE WHEN has THEN 1 ELSE 0 END AS i FROM t JOIN s USING (conv_id) WHERE NOT (has AND k = 1)),
c AS (SELECT conv_id, list(p ORDER BY i) AS p, count(*) AS n FROM
        (SELECT conv_id, i, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM r) GROUP BY conv_id),
q AS (SELECT conv_id, n, list_prepend(0, p) AS p, 768 - head AS room FROM c JOIN s USING (conv_id)),
a AS (SELECT conv_id, n, p, room, -1 AS win, 0 AS h, 0 AS b, 0 AS e, false AS over FROM q
      UNION ALL
      SELECT conv_id, n, p, room, win + 1, CASE WHEN e1 > e THEN h1 ELSE e END, e,
             CASE WHEN e1 > e THEN e1 ELSE greatest(e2, e + 1) END, e1 <= e AND e2 <= e
      FROM (SELECT *, len(list_filter(p, lambda x: x <= p[h1 + 1] + room)) - 1 AS e1,
                   len(list_filter(p, lambda x: x <= p[e + 1] + room)) - 1 AS e2
            FROM (SELECT *, len(list_filter(p, lambda x: x < p[e + 1] - 192)) AS h1 FROM a WHERE e < n)))
SELECT a.conv_id, a.win::INTEGER AS window,
       min(r.turn) AS history_turn, min(r.turn) FILTER (r.i > a.b) AS first_turn, max(r.turn) AS last_turn,
       (sum(r.tokens) + any_value(s.head))::BIGINT AS n_tokens,
       coalesce(sum(r.tokens) FILTER (r.i > a.b AND r.role = 'assistant'), 0)::BIGINT AS target_tokens,
       CASE WHEN any_value(s.has) THEN '0' ELSE '' END || string_agg(CASE WHEN r.i > a.b AND r.role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY r.i) AS mask,
       any_value(a.over) AS over_budget,
       CASE WHEN any_value(s.has) THEN '<|system|>' || chr(10) || any_value(s.text) || chr(10) ELSE '' END
         || string_agg('<|' || r.role || '|>' || chr(10) || r.text || chr(10), '' ORDER BY r.i) AS text
FROM a JOIN r ON r.conv_id = a.conv_id AND r.i > a.h AND r.i <= a.e JOIN s ON s.conv_id = a.conv_id
WHERE a.win >= 0 GROUP BY a.conv_id, a.win
"""


def _repeats(most: int = 25_600) -> str:
    """Windows of 50, 100, ... words that stand in two documents, and the stretches they cover."""
    levels, length, last = [], 50, "v"
    sql = [
        f"WITH w AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)",
        "v AS (SELECT doc_id, i AS pos, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM w WHERE len(w) >= 50))",
    ]
    while length <= most:
        sql.append(f"r{length} AS (SELECT DISTINCT doc_id, pos, h FROM {last} WHERE h IN (SELECT h FROM {last} GROUP BY h HAVING count(DISTINCT doc_id) > 1))")
        sql.append(f"v{length} AS (SELECT a.doc_id, a.pos, md5(a.h || b.h) AS h FROM r{length} a JOIN r{length} b ON a.doc_id = b.doc_id AND b.pos = a.pos + {length})")
        levels.append(f"SELECT doc_id, pos, pos + {length} AS stop, {length} AS len FROM r{length}")
        last, length = f"v{length}", 2 * length
    sql += [
        f"u AS ({' UNION ALL '.join(levels)})",
        "b AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY pos, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM u)",
        "p AS (SELECT *, sum(CASE WHEN seen >= pos THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos, stop ROWS UNBOUNDED PRECEDING) AS part FROM b)",
    ]
    return ", ".join(sql) + " SELECT doc_id, min(pos)::INTEGER AS first_word, max(stop)::INTEGER AS end_word, (max(stop) - min(pos))::INTEGER AS n_words, max(len)::INTEGER AS longest FROM p GROUP BY doc_id, part"


REPEATS = _repeats()


def _warc() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    mark = "\x01"
    names, values = (f"string_split({quote(mark.join(x))}, {quote(mark)})" for x in (warc.ENTITIES, warc.ENTITIES.values()))
    known = f"map({names}, {values})"
    c1 = f"map({list(warc.C1)}, {list(warc.C1.values())})"

    def replaced(c: str) -> str:
        name = f"regexp_extract(x, '{warc.ENTITY}', 1)"
        number = f"CASE WHEN lower(substr({name}, 2, 1)) = 'x' THEN try_cast('0x' || substr({name}, 3) AS BIGINT) ELSE try_cast(substr({name}, 2) AS BIGINT) END"
        number = f"coalesce({c1}[try_cast({number} AS INTEGER)], {number}, 0)"
        char = f"CASE WHEN {number} = 0 OR {number} BETWEEN 55296 AND 57343 OR {number} > 1114111 THEN chr(65533) ELSE chr(({number})::INTEGER) END"
        value = f"CASE WHEN starts_with({name}, '#') THEN {char} ELSE {known}[{name}] END"
        piece = f"coalesce({value} || substr(x, length({name}) + 2), '&' || x)"
        return f"(string_split({c}, '&')[1] || array_to_string(list_transform(string_split({c}, '&')[2:], lambda x: {piece}), ''))"

    body = f"regexp_replace(html, {quote(warc.DROPPED)}, ' ', 'g')"
    body = f"regexp_replace(regexp_replace({body}, {quote(warc.BREAKS)}, chr(10), 'g'), {quote(warc.TAGS)}, '', 'g')"
    body = f"regexp_replace({replaced(body)}, '{warc.BLANKS}', ' ', 'g')"
    body = f"trim(regexp_replace({body}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"
    crlf = "chr(13) || chr(10)"
    field = lambda name, value: f"CASE WHEN {value} <> '' THEN '{name}: ' || {value} || {crlf} ELSE '' END"
    uuid = lambda c: f"'<urn:uuid:' || substr(md5({c}), 1, 8) || '-' || substr(md5({c}), 9, 4) || '-' || substr(md5({c}), 13, 4) || '-' || substr(md5({c}), 17, 4) || '-' || substr(md5({c}), 21, 12) || '>'"
    title = replaced("regexp_extract(html, " + quote(warc.TITLE) + ", 1)")
    title = f"trim(regexp_replace({title}, '[\\s\u00a0]+', ' ', 'g'))"
    value = lambda c: f"regexp_replace({c}, {quote(warc.QUOTES)}, '', 'g')"
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
r AS (SELECT page_id, url AS target_uri, html, {uuid("('response|' || page_id || '|' || coalesce(url, ''))")} AS refers_to,
        'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(html) || {crlf} || {crlf} AS source_headers,
        'sha256:' || sha256(html) AS source_digest, {title} AS title, {value(f"regexp_extract(html, {quote(warc.LANGUAGE)}, 1)")} AS language,
        list_transform(regexp_extract_all(html, {quote(warc.LINK)}, 1), lambda x: {value("x")}) AS found FROM p),
l AS (SELECT *, list_filter(found, lambda x, i: list_position(found, x) = i) AS links FROM r),
b AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
        {field("title", "title")} || {field("language", "language")} || coalesce(array_to_string(list_transform(links, lambda link: 'outlink: ' || {replaced("link")} || ' L a/@href' || {crlf}), ''), '') AS block FROM l
      UNION ALL
      SELECT * FROM (SELECT *, 'conversion', 'text/plain; charset=utf-8', {body} AS block FROM l) WHERE block <> '')
SELECT page_id, record_type, {uuid("(record_type || '|' || refers_to)")} AS record_id, refers_to, target_uri, '2024-01-01T00:00:00Z' AS warc_date, content_type,
       strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest, source_headers, block FROM b
"""


WARC = _warc()
