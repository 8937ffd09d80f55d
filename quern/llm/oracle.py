"""DuckDB SQL of the queries that SQL can express: each gives the rows of the query of its name."""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Pairs of links as components: reachable ids by recursion, the least of which names the component.
REACHED = """
    both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
    reached(id, other) AS (SELECT x, y FROM both_ways UNION SELECT r.id, b.y FROM reached r JOIN both_ways b ON r.other = b.x),
    components AS (SELECT id, least(id, min(other)) AS component_id FROM reached GROUP BY id)
"""

JACCARD = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(1, greatest(len(ws) - 1, 2)), lambda i: array_to_string(ws[i:i+2], ' ')) END) AS s FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (
    SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
    {REACHED}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN components c ON c.id = d.doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE vectors AS (
    SELECT vec_id AS id, label AS l, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
    SELECT a.id AS x, b.id AS y FROM vectors a JOIN vectors b ON a.l = b.l AND a.id < b.id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    {REACHED},
    counts AS (SELECT x AS id, count(*) AS n FROM both_ways GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN counts k ON k.id = vec_id LEFT JOIN components c ON c.id = vec_id
"""

_WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
    windows AS (
    SELECT DISTINCT item_id, size, array_to_string(ws[i:i+size-1], ' ') AS w
    FROM (SELECT *, least(len(ws), 13) AS size, unnest(range(1, greatest(len(ws) - 11, 2))) AS i FROM items WHERE len(ws) > 0)),
    words AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    places AS (
    SELECT doc_id, size, i, array_to_string(ws[i:i+size-1], ' ') AS w
    FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM words, (SELECT DISTINCT size FROM windows) WHERE len(ws) >= size)),
    found AS (SELECT doc_id, p.size, i, item_id FROM places p JOIN windows v ON v.size = p.size AND v.w = p.w),
    hits AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS at FROM found) GROUP BY doc_id),
    names AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM words w LEFT JOIN hits h ON h.doc_id = w.doc_id LEFT JOIN names n ON n.doc_id = w.doc_id
"""

#: The table of crc32 is made from its polynomial; words beyond ASCII are of U+00C0 to U+00FF, two bytes each.
SPELLING = """
WITH RECURSIVE
    t AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v FROM range(256) r(i))),
    runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents),
    own AS (SELECT k, run, count(*) AS n FROM runs GROUP BY ALL),
    coded AS (
    SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(k || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)),
           lambda h, b: xor(h >> 8, crc[1 + xor(h & 255, b)]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM own, t),
    damaged AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM coded),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
    pairs AS (
    SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.short = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.short = b.word),
    near AS (SELECT word, count(*) AS n_near, min((-m, encode(other))) AS best FROM pairs GROUP BY word),
    said AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 10 * w.n THEN decode(best[2]) END AS form, CASE WHEN -best[1] >= 10 * w.n THEN -best[1] END AS form_n
    FROM words w LEFT JOIN near USING (word)),
    led AS (SELECT word, word AS last, 0 AS steps FROM said UNION ALL SELECT l.word, s.form, steps + 1 FROM led l JOIN said s ON s.word = l.last WHERE s.form IS NOT NULL),
    roots AS (SELECT word, arg_max(last, steps) AS root FROM led GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM said JOIN roots USING (word)
"""

ORACLE_SQL = {"op2_jaccard_join": JACCARD, "op5_embeddings": EMBEDDINGS, "op8_decontaminate": DECONTAMINATION, "op12_spelling_groups": SPELLING}
