"""DuckDB SQL for the queries that SQL can express."""


def _position(need: str) -> str:
    """The time at which a source's schedule (falling, level or rising, in turn) has integrated to this share."""
    return f"""CASE WHEN {need} IS NULL THEN NULL
    WHEN rank % 3 = 0 THEN CASE WHEN {need} <= 0.625 THEN (sqrt(greatest(2.25::DOUBLE - 2.0::DOUBLE * {need}, 0)) - 1.5::DOUBLE) / -1.0::DOUBLE
      WHEN {need} <= 1.0 THEN 0.5::DOUBLE + (sqrt(greatest(1.0::DOUBLE - 2.0::DOUBLE * ({need} - 0.625::DOUBLE), 0)) - 1.0::DOUBLE) / -1.0::DOUBLE ELSE 1.0::DOUBLE END
    WHEN rank % 3 = 1 THEN CASE WHEN {need} <= 0.5 THEN {need} WHEN {need} <= 1.0 THEN 0.5::DOUBLE + ({need} - 0.5::DOUBLE) ELSE 1.0::DOUBLE END
    ELSE CASE WHEN {need} <= 0.375 THEN sqrt(greatest(0.25::DOUBLE + 2.0::DOUBLE * {need}, 0)) - 0.5::DOUBLE
      WHEN {need} <= 1.0 THEN 0.5::DOUBLE + (sqrt(greatest(1.0::DOUBLE + 2.0::DOUBLE * ({need} - 0.375::DOUBLE), 0)) - 1.0::DOUBLE) ELSE 1.0::DOUBLE END END"""


OP2 = r"""
WITH q AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM q GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
f AS (SELECT *, cap / weight AS ratio,
        (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT arg_min(level, (ratio, rank)) AS fit FROM f WHERE level <= ratio),
t AS (SELECT source, source_size, rank, least(cap, coalesce(weight * fit, cap)) AS target FROM f LEFT JOIN l ON true),
p AS (SELECT q.doc_id, q.size, t.source_size, t.target, t.rank,
        coalesce(sum(q.size) OVER (PARTITION BY q.source ORDER BY turn, q.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source),
s1 AS (SELECT *, CAST(greatest(0, least(size, floor(target) - start)) AS BIGINT) AS w1, CAST(greatest(0, least(size, floor(target) - source_size - start)) AS BIGINT) AS w2 FROM p),
s2 AS (SELECT *, CASE WHEN w1 > 0 THEN (CAST(start AS DOUBLE) + w1 / 2.0::DOUBLE) / target END AS n1, CASE WHEN w2 > 0 THEN (CAST(source_size + start AS DOUBLE) + w2 / 2.0::DOUBLE) / target END AS n2 FROM s1)
SELECT doc_id, size, source_size, target, w1 + w2 AS taken, {0} AS position_1, {1} AS position_2
FROM s2
""".format(_position("n1"), _position("n2"))

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d)),
k AS (SELECT key, max(doc_id) AS last_doc FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS BIGINT) >= 3),
m AS (SELECT r, l.doc_id, i, line, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.last_doc AS gone FROM l LEFT JOIN k USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""

OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM g JOIN r USING (h), (SELECT unnest(generate_series(0, 34)) AS j)),
e AS (SELECT w.doc_id, i, word, c.p IS NOT NULL AS gone FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w) w LEFT JOIN c ON w.doc_id = c.doc_id AND w.i = c.p)
SELECT w.doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM w LEFT JOIN e ON w.doc_id = e.doc_id GROUP BY w.doc_id
"""

OP7 = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""

OP11 = r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest[length(raw) + 1:], '^[^?#]*') AS path FROM h),
d AS (SELECT *, CASE WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule, host || path AS u FROM c),
g AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN regexp_full_match(u, '.*cheap-pills.*/.*', 's') THEN '**cheap-pills*/**'
    WHEN regexp_matches(u, '^[^/]*/robots\.txt$') THEN '*/robots.txt'
    WHEN regexp_full_match(u, '.*free-bets[^/]*/.*', 's') THEN '**free-bets*/**'
    WHEN regexp_full_match(u, '.*/wp-admin/.*', 's') THEN '**/wp-admin/**'
    WHEN regexp_full_match(u, '.*casino-[^/]*/.*', 's') THEN '**casino-*/**'
    WHEN regexp_full_match(u, '[^/]*\.ads-[^/]*/.*', 's') THEN '*.ads-*/**'
    WHEN regexp_full_match(u, '.*/cart/.*', 's') THEN '**/cart/**'
    WHEN regexp_full_match(u, 'ads-[^/]*/.*', 's') THEN 'ads-*/**'
    WHEN ends_with(u, '.exe') THEN '**.exe' WHEN ends_with(u, '.zip') THEN '**.zip' END AS pattern FROM d)
SELECT page_id, host, path, rule, pattern, CASE WHEN coalesce(rule, '') IN ('org/', 'com/fr/') OR coalesce(pattern, '') = '*/robots.txt' THEN 'allow'
    WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM g
"""

OP12 = r"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, code) AS pos, code, tokens
      FROM (SELECT c, turn, md5(length(role) || ':' || role || text) AS code, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens FROM t)),
h AS (SELECT c, c - c % 20 AS first, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
u AS (SELECT h.c, 0 AS part, o.pos, code, tokens FROM h JOIN o ON o.c = h.first AND o.pos <= h UNION ALL SELECT h.c, 1, o.pos, code, tokens FROM h JOIN o ON o.c = h.c AND o.pos > h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS pos, code, tokens FROM u),
k AS (SELECT c, pos AS depth, md5(string_agg(code, '') OVER (PARTITION BY c ORDER BY pos)) AS key, tokens FROM r UNION ALL SELECT c, 0, 'root', 0 FROM h),
p AS (SELECT c, depth, key, tokens, lag(key) OVER (PARTITION BY c ORDER BY depth) AS above, lead(key) OVER (PARTITION BY c ORDER BY depth) IS NULL AS last FROM k),
n AS (SELECT key, any_value(depth) AS depth, any_value(above) AS above, any_value(tokens) AS tokens, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY key),
f AS (SELECT above AS key, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY above),
s AS (SELECT k.key, sum((n.n_convs - 1) * n.tokens) AS saved_tokens, count(*) FILTER (f.key IS NULL) AS n_leaves FROM n LEFT JOIN f ON n.key = f.key JOIN k ON k.c = n.conv_id AND k.depth <= n.depth GROUP BY k.key)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n m ON m.key = n.above LEFT JOIN f ON f.key = n.key JOIN s ON s.key = n.key
"""

OP13 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(ps) AS piece FROM t)),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE m > 1 AND n >= 30),
k AS (SELECT lang, m, phrase, n AS a, k, array_to_string(s[1:k], ' ') AS first, array_to_string(s[k + 1:], ' ') AS rest FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c)),
q AS (SELECT k.*, x.n AS l, y.n AS r, (2000000::HUGEINT * a) // (x.n + y.n) AS score FROM k JOIN f x ON k.lang = x.lang AND k.first = x.phrase AND x.m = k JOIN f y ON k.lang = y.lang AND k.rest = y.phrase AND y.m = k.m - k),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.m > b.m AND 100 * c.n >= 80 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM d JOIN (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang) USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

ORACLES = {"op11_url_filters": OP11, "op12_prefix_trie": OP12, "op13_collocations": OP13, "op1_substring_dedup": OP1, "op2_mixing": OP2, "op7_embedding_dedup": OP7, "op8_line_dedup": OP8}
