"""Queries over texts: access, cleaning, scanning, chunking, duplicates, splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..operators import access, chunking, duplicates, splits
from ..sources.tables import table
from .registry import query

GROUPS = "[source, 'g' || (doc_id % 7)]"


def _documents(spark, d):
    """Documents as a tenant's: the language is the tenant, groups are derived from source and id."""
    groups = F.array("source", F.concat(F.lit("g"), (F.col("doc_id") % 7).cast("string")))
    return table(spark, d, "documents").withColumns({"tenant": F.col("lang"), "acl_groups": groups})


@query("acl_visible", f"SELECT doc_id, lang AS tenant, source FROM documents WHERE lang IN ('en', 'fr') AND list_has_any({GROUPS}, ['src1', 'src2', 'g3'])")
def acl_visible(spark, d):
    seen = access.visible(_documents(spark, d), "en", ["src1", "src2", "g3"], shared="fr")
    return seen.select("doc_id", "tenant", "source")


@query(
    "acl_violations",
    f"""SELECT lang AS tenant, count(*)::BIGINT AS n_docs, count(*) FILTER (WHERE NOT (lang IN ('en', 'fr') AND list_has_any({GROUPS}, ['src1', 'g3'])))::BIGINT AS n_forbidden
    FROM documents GROUP BY lang""",
)
def acl_violations(spark, d):
    marked = access.marked(_documents(spark, d), "en", ["src1", "g3"], shared="fr")
    return marked.groupBy("tenant").agg(F.count("*").alias("n_docs"), F.count_if(~F.col("allowed")).alias("n_forbidden"))


@query(
    "metadata_filter",
    "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'purchase') AND user_id % 10 NOT IN (3, 4) AND ts > TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'",
)
def metadata_filter(spark, d):
    events = table(spark, d, "events")
    kept = access.filtered(events, any_of={"event_type": ["click", "purchase"]}, after=("ts", "2024-01-10"), before=("ts", "2024-01-20"))
    return kept.where(~(F.col("user_id") % 10).isin(3, 4)).select("event_id", "user_id", "event_type")


@query(
    "first_fail_reasons",
    """SELECT reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty_text' WHEN length(text) < 200 THEN 'too_short'
    WHEN length(text) > 8000 THEN 'too_long' WHEN quality IS NULL THEN 'empty_label' ELSE 'kept' END AS reason FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY reason""",
)
def first_fail_reasons(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rules = [
        ("empty_text", F.col("text").isNull() | (F.trim("text") == "")),
        ("too_short", F.length("text") < 200),
        ("too_long", F.length("text") > 8000),
        ("empty_label", F.col("quality").isNull()),
    ]
    return rows.select(access.first_failing(rules).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "whitespace_normalised",
    r"""SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
    '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS t FROM documents)""",
)
def whitespace_normalised(spark, d):
    t = table(spark, d, "documents").select("doc_id", tx.whitespace_normalised(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query(
    "match_normalised",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS digest FROM documents""",
)
def match_normalised(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.match_normalised(F.col("text"))).alias("digest"))


@query(
    "cache_keys",
    r"""SELECT key, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM (SELECT doc_id, sha256(regexp_replace(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')), '[?.! ]+$', '')) AS key
    FROM documents) GROUP BY key""",
)
def cache_keys(spark, d):
    keyed = table(spark, d, "documents").select("doc_id", F.sha2(tx.cache_key(F.col("text")), 256).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(
    "boilerplate_lines",
    r"""SELECT doc_id, len(lines)::BIGINT AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^(This work is licensed|Licensed under|Copyright|SPDX)')))::BIGINT AS n_dropped
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)""",
)
def boilerplate_lines(spark, d):
    lines = F.split("text", "\n")
    dropped = F.filter(lines, lambda x: x.rlike("^(This work is licensed|Licensed under|Copyright|SPDX)"))
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"))


@query(
    "repeated_lines",
    """SELECT md5(line) AS line_md5, count(DISTINCT doc_id)::BIGINT AS n_docs, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT doc_id) >= 3""",
)
def repeated_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 20)
    per_doc = lines.groupBy(F.md5("line").alias("line_md5"), "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("line_md5").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n")).where("n_docs >= 3")


@query(
    "token_estimates",
    r"""SELECT doc_id, ceil(dig / 2.0 + (asc_n - dig) / 4.0 + (strlen(text) - asc_n) / 4.0)::BIGINT AS n_tokens FROM (SELECT doc_id, text,
    length(regexp_replace(text, '[^0-9]', '', 'g')) AS dig, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS asc_n FROM documents)""",
)
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("n_tokens"))


@query(
    "distinct_shingles",
    r"""SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i+4], ' ')))) END::BIGINT AS n
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents)""",
)
def distinct_shingles(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.shingles(tx.words(F.col("text")), 5)).cast("long").alias("n"))


@query(
    "private_data_counts",
    rf"""SELECT doc_id, len(regexp_extract_all(text, '{tx.EMAIL}'))::BIGINT AS n_email, len(regexp_extract_all(text, '{tx.IPV4}'))::BIGINT AS n_ip,
    len(regexp_extract_all(text, '{tx.PHONE}'))::BIGINT AS n_phone, len(regexp_extract_all(text, '{tx.LONG_NUMBER}'))::BIGINT AS n_number FROM documents""",
)
def private_data_counts(spark, d):
    counts = {"n_email": (tx.EMAIL_ONCE, "@"), "n_ip": (tx.IPV4, "."), "n_phone": (tx.PHONE, "+"), "n_number": (tx.LONG_NUMBER, "")}
    return table(spark, d, "documents").select("doc_id", *[tx.count_of(F.col("text"), p, sign).alias(n) for n, (p, sign) in counts.items()])


@query(
    "private_data_scrubbed",
    rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{tx.EMAIL}', '[EMAIL]', 'g'), '{tx.LONG_NUMBER}', '[NUMBER]', 'g'), '{tx.PHONE}', '[PHONE]', 'g')) AS digest FROM documents""",
)
def private_data_scrubbed(spark, d):
    t: Column = F.col("text")
    for pattern, mark in ((tx.EMAIL_ONCE, "[EMAIL]"), (tx.LONG_NUMBER, "[NUMBER]"), (tx.PHONE, "[PHONE]")):
        t = F.regexp_replace(t, pattern, mark)
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("digest"))


@query("secret_scan", rf"""SELECT source, count(*) FILTER (WHERE regexp_matches(text, '{tx.SECRET}'))::BIGINT AS n_secret, count(*)::BIGINT AS n FROM documents GROUP BY source""")
def secret_scan(spark, d):
    found = table(spark, d, "documents").groupBy("source")
    return found.agg(F.count_if(F.col("text").rlike(tx.SECRET)).alias("n_secret"), F.count("*").alias("n"))


#: Signs of text that gives orders to a reader, and how far each is to be believed.
SIGNALS = ((r"(?i)ignore (all|any|previous)", 0.6), (r"(?i)system prompt", 0.5), (r"(?i)\bpassword\b", 0.3), (r"!!", 0.1), (r"[$%&*]{3}", 0.1))


@query(
    "injection_scores",
    "SELECT doc_id, round(1 - " + " * ".join(f"(CASE WHEN regexp_matches(text, '{p}') THEN {1 - w:.1f} ELSE 1.0 END)" for p, w in SIGNALS) + ", 6)::DOUBLE AS score FROM documents",
)
def injection_scores(spark, d):
    score = tx.noisy_or([(F.col("text").rlike(p), w) for p, w in SIGNALS])
    return table(spark, d, "documents").select("doc_id", F.round(score, 6).alias("score"))


@query(
    "url_parts",
    r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
    regexp_matches(url, '^https://([a-z0-9-]+\.)*example\.(com|org)(/|$)') AS allowed FROM pages""",
)
def url_parts(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract(url, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1).alias("host"),
        url.rlike(r"^https://([a-z0-9-]+\.)*example\.(com|org)(/|$)").alias("allowed"),
    )


@query("content_hashes", "SELECT doc_id, sha256(text) AS content_hash, substr(sha256(text), 1, 16) AS short_hash FROM documents")
def content_hashes(spark, d):
    digest = F.sha2("text", 256)
    return table(spark, d, "documents").select("doc_id", digest.alias("content_hash"), F.substring(digest, 1, 16).alias("short_hash"))


@query(
    "json_path",
    "SELECT event_type, count(json_extract_string(props, '$.k'))::BIGINT AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type",
)
def json_path(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k.cast("long")).alias("total"))


WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')"


@query(
    "word_windows",
    f"""SELECT doc_id, i::BIGINT AS position, len(w[i*48+1:i*48+64])::BIGINT AS n_words, md5(array_to_string(w[i*48+1:i*48+64], ' ')) AS digest FROM
    (SELECT doc_id, w, unnest(generate_series(0, greatest(ceil((len(w) - 64) / 48.0), 0)::INT)) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 0)""",
)
def word_windows(spark, d):
    chunks = chunking.word_windows(table(spark, d, "documents"), 64, 16)
    return chunks.select("doc_id", "position", F.col("n_words").cast("long").alias("n_words"), F.md5("chunk").alias("digest"))


@query(
    "char_windows",
    """SELECT doc_id, i::BIGINT AS position, md5(substr(text, i * 400 + 1, 500)) AS digest FROM (SELECT doc_id, text,
    unnest(generate_series(0, greatest(ceil((length(text) - 500) / 400.0), 0)::INT)) AS i FROM documents WHERE length(text) > 0)""",
)
def char_windows(spark, d):
    return chunking.char_windows(table(spark, d, "documents"), 500, 100).select("doc_id", "position", F.md5("chunk").alias("digest"))


@query(
    "paragraphs",
    """SELECT doc_id, i::BIGINT AS position, sum(length(p[j]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(p[j]) - 1 AS char_start, length(p[j])::BIGINT AS n_chars
    FROM (SELECT doc_id, p, i, i + 1 AS j FROM (SELECT doc_id, string_split(text, chr(10)) AS p, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i FROM documents))""".replace(
        "AS char_start", "::BIGINT AS char_start").replace("sum(length(p[j]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(p[j]) - 1 ::", "(sum(length(p[j]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(p[j]) - 1)::"),
)
def paragraphs(spark, d):
    return chunking.paragraphs(table(spark, d, "documents")).select("doc_id", "position", "char_start", "n_chars")


@query(
    "exact_duplicates",
    """SELECT doc_id AS dropped, kept FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY lang, source, md5(text)) AS kept FROM documents) WHERE doc_id <> kept""",
)
def exact_duplicates(spark, d):
    return duplicates.dropped_copies(table(spark, d, "documents"), ["lang", "source"], "text", "doc_id")


@query(
    "label_conflicts",
    r"""SELECT key, count(*)::BIGINT AS n, min(doc_id) AS kept, count(DISTINCT quality)::BIGINT AS n_labels FROM
    (SELECT doc_id, quality, sha256(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g'))) AS key FROM documents JOIN labels USING (doc_id)) GROUP BY key HAVING count(*) > 1""",
)
def label_conflicts(spark, d):
    key = F.sha2(F.trim(F.regexp_replace(F.lower("text"), "[ \t\n\r]+", " ")), 256).alias("key")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "quality", key)
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("kept"), F.count_distinct("quality").alias("n_labels")).where("n > 1")


@query(
    "minhash_pairs",
    r"""WITH RECURSIVE classes AS (SELECT min(doc_id) AS k, min(text) AS t FROM documents WHERE length(trim(text)) > 0 GROUP BY md5(text)),
    words AS (SELECT k, list_filter(regexp_split_to_array(t, '[ \t\n\r]+'), lambda x: x <> '') AS ws FROM classes),
    shingles AS (SELECT DISTINCT k, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i+4], ' '))) AS s FROM words WHERE len(ws) > 0),
    sizes AS (SELECT k, count(*) AS n FROM shingles GROUP BY k),
    shared AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.k < b.k GROUP BY ALL),
    links AS (SELECT x, y FROM shared JOIN sizes a ON a.k = x JOIN sizes b ON b.k = y WHERE round(c::DOUBLE / (a.n + b.n - c), 6) >= 0.8),
    both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
    reached(id, other) AS (SELECT x, y FROM both_ways UNION SELECT r.id, b.y FROM reached r JOIN both_ways b ON r.other = b.x),
    components AS (SELECT id, least(id, min(other)) AS component_id FROM reached GROUP BY id)
SELECT d.doc_id, coalesce(c.k, d.doc_id) AS class_id, coalesce(component_id, c.k, d.doc_id) AS component_id FROM documents d LEFT JOIN classes c ON c.t = d.text LEFT JOIN components m ON m.id = c.k""",
)
def minhash_pairs(spark, d):
    """Classes of equal texts and components of similar ones; bands find a pair at the limit with probability 0.9998."""
    return duplicates.minhash_groups(table(spark, d, "documents"), "doc_id", "text", least=0.8)


BUCKET = "(('0x' || substr(sha256('{}:' || {}), 1, 12))::UBIGINT / 281474976710656.0)"


@query("holdout_split", f"SELECT source, count(*) FILTER (WHERE b < 0.2)::BIGINT AS n_test, count(*) FILTER (WHERE b >= 0.2)::BIGINT AS n_train FROM (SELECT source, {BUCKET.format('split', 'source')} AS b FROM documents) GROUP BY source")
def holdout_split(spark, d):
    rows = splits.holdout(table(spark, d, "documents"), "source", 0.2, "split")
    return rows.groupBy("source").agg(F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train"))


@query(
    "split_leakage",
    f"""SELECT count(*)::BIGINT AS n_shared FROM (SELECT md5(text) AS h FROM documents WHERE {BUCKET.format('leak', 'doc_id')} < 0.3 INTERSECT
    SELECT md5(text) FROM documents WHERE {BUCKET.format('leak', 'doc_id')} >= 0.3)""",
)
def split_leakage(spark, d):
    rows = splits.holdout(table(spark, d, "documents"), "doc_id", 0.3, "leak")
    return splits.shared_texts(rows, "text").agg(F.count("*").alias("n_shared"))


@query("time_split", f"SELECT CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN 'test' WHEN {BUCKET.format('time', 'user_id')} < 0.1 THEN 'validation' ELSE 'train' END AS part, count(*)::BIGINT AS n FROM events GROUP BY 1")
def time_split(spark, d):
    part = F.when(F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz"), "test").when(tx.bucket(F.col("user_id"), "time") < 0.1, "validation").otherwise("train")
    return table(spark, d, "events").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query(
    "rollout",
    f"""SELECT CASE WHEN b < 0.05 THEN 'canary' WHEN b < 0.5 THEN 'new' ELSE 'old' END AS variant, count(DISTINCT user_id)::BIGINT AS n_users, round(avg(value), 6) AS mean_value
    FROM (SELECT user_id, value, {BUCKET.format('flag', 'user_id')} AS b FROM events) GROUP BY 1""",
)
def rollout(spark, d):
    variant = splits.variant(F.col("user_id"), "flag", [("canary", 0.05), ("new", 0.45), ("old", 0.5)])
    return table(spark, d, "events").groupBy(variant.alias("variant")).agg(F.count_distinct("user_id").alias("n_users"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(
    "stratified_sample",
    f"""SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {BUCKET.format('review', 'event_id')}, event_id) AS r FROM events) WHERE r <= 20""",
)
def stratified_sample(spark, d):
    return splits.sample_per_stratum(table(spark, d, "events"), "event_type", "event_id", 20, "review").select("event_type", "event_id")


@query(
    "label_artefacts",
    r"""SELECT word, n, round(pos::DOUBLE / n, 6) AS purity FROM (SELECT word, count(*)::BIGINT AS n, sum(toxic)::BIGINT AS pos FROM (SELECT DISTINCT doc_id, toxic,
    unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS word FROM documents JOIN labels USING (doc_id)) GROUP BY word) WHERE n >= 20 AND (pos >= 0.98 * n)""",
)
def label_artefacts(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    word = F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")))
    counts = rows.select("doc_id", "toxic", word.alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos"))
    return counts.where((F.col("n") >= 20) & (F.col("pos") >= 0.98 * F.col("n"))).select("word", "n", F.round(F.col("pos") / F.col("n"), 6).alias("purity"))


@query(
    "conversation_tail",
    """SELECT conv_id, turn, role, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3""",
)
def conversation_tail(spark, d):
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").withColumn("r", last).where("r <= 3").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query(
    "conversation_fold",
    """SELECT conv_id, count(*)::BIGINT AS n_turns, count(*) FILTER (WHERE role = 'user')::BIGINT AS n_user, sum(length(text))::BIGINT AS n_chars, (max(turn) - min(turn) + 1 = count(*)) AS unbroken
    FROM conversations GROUP BY conv_id""",
)
def conversation_fold(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("text")).alias("n_chars"),
        (F.max("turn") - F.min("turn") + 1 == F.count("*")).alias("unbroken"),
    )
