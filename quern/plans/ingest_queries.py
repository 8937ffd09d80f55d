"""Queries of ingestion: what changed, what is replaced, and states that rows change in order.

The stored state is the documents as an earlier run left them: some were not there, some have changed since.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..operators import chunking, folds
from ..sources.tables import table
from .registry import query

STORED = """(SELECT doc_id, md5(text || CASE WHEN doc_id % 5 = 0 THEN ' old' ELSE '' END) AS hash, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS acl,
    CASE WHEN doc_id % 17 = 0 THEN 'moved' ELSE source END AS source FROM documents WHERE doc_id % 7 <> 0)"""
CURRENT = "(SELECT doc_id, md5(text) AS hash, lang AS acl, source FROM documents WHERE doc_id % 13 <> 0)"
CHANGES = f"""(SELECT coalesce(c.doc_id, s.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'deleted' WHEN s.doc_id IS NULL THEN 'new' WHEN c.hash <> s.hash THEN 'content'
    WHEN c.acl <> s.acl THEN 'acl_only' WHEN c.source <> s.source THEN 'metadata' ELSE 'unchanged' END AS change FROM {CURRENT} c FULL JOIN {STORED} s ON c.doc_id = s.doc_id)"""


def _changes(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    every = F.col("doc_id")
    stored = documents.where(every % 7 != 0).select(
        F.col("doc_id").alias("s_id"), F.md5(F.concat("text", F.when(every % 5 == 0, " old").otherwise(""))).alias("s_hash"),
        F.when(every % 11 == 0, "xx").otherwise(F.col("lang")).alias("s_acl"), F.when(every % 17 == 0, "moved").otherwise(F.col("source")).alias("s_source"),
    )
    current = documents.where(every % 13 != 0).select("doc_id", F.md5("text").alias("hash"), F.col("lang").alias("acl"), "source")
    both = current.join(stored, F.col("doc_id") == F.col("s_id"), "full")
    change = (
        F.when(F.col("doc_id").isNull(), "deleted").when(F.col("s_id").isNull(), "new").when(F.col("hash") != F.col("s_hash"), "content")
        .when(F.col("acl") != F.col("s_acl"), "acl_only").when(F.col("source") != F.col("s_source"), "metadata").otherwise("unchanged")
    )
    return both.select(F.coalesce("doc_id", "s_id").alias("doc_id"), change.alias("change"))


@query("change_classes", f"SELECT doc_id, change FROM {CHANGES}")
def change_classes(spark, d):
    """new, content, acl_only, metadata, unchanged or deleted: digests and small columns are shuffled, no texts."""
    return _changes(spark, d)


@query("sync_plan", f"SELECT CASE change WHEN 'deleted' THEN 'delete' WHEN 'unchanged' THEN 'none' ELSE 'upsert' END AS action, change, count(*)::BIGINT AS n FROM {CHANGES} GROUP BY 1, 2")
def sync_plan(spark, d):
    action = F.when(F.col("change") == "deleted", "delete").when(F.col("change") == "unchanged", "none").otherwise("upsert")
    return _changes(spark, d).groupBy(action.alias("action"), "change").agg(F.count("*").alias("n"))


N_WINDOWS = "greatest(ceil((len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) - 64) / 48.0), 0) + 1"


@query(
    "incremental_ingest",
    f"""SELECT doc_id, CASE change WHEN 'deleted' THEN 'pruned' WHEN 'unchanged' THEN 'skipped' WHEN 'new' THEN 'added' ELSE 'replaced' END AS action,
    (CASE WHEN change IN ('deleted', 'unchanged') OR length(trim(text)) = 0 THEN 0 ELSE {N_WINDOWS} END)::BIGINT AS n_chunks FROM {CHANGES} JOIN documents USING (doc_id)""",
)
def incremental_ingest(spark, d):
    """Only texts that are new or changed are cut into windows."""
    n = F.size(tx.words(F.col("text")))
    windows = F.when(n > 0, F.greatest(F.ceil((n - 64) / 48), F.lit(0)) + 1).otherwise(0)
    action = F.when(F.col("change") == "deleted", "pruned").when(F.col("change") == "unchanged", "skipped").when(F.col("change") == "new", "added").otherwise("replaced")
    rows = table(spark, d, "documents").select("doc_id", "text").join(_changes(spark, d), "doc_id")
    return rows.select("doc_id", action.alias("action"), F.when(F.col("change").isin("deleted", "unchanged"), 0).otherwise(windows).cast("long").alias("n_chunks"))


@query(
    "replaced_chunks",
    """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), new AS (SELECT doc_id, md5(t) AS chunk FROM lines WHERE doc_id % 10 = 0),
    old AS (SELECT doc_id, md5(t || ' old') AS chunk FROM lines) SELECT doc_id, count(*)::BIGINT AS n_chunks, min(chunk) AS first_chunk FROM
    (SELECT * FROM new UNION ALL SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)) GROUP BY doc_id""",
)
def replaced_chunks(spark, d):
    """The given chunks of a document become its only ones: the old ones of these documents go in one anti-join."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    new = lines.where(F.col("doc_id") % 10 == 0).select("doc_id", F.md5("t").alias("chunk"))
    old = lines.select("doc_id", F.md5(F.concat("t", F.lit(" old"))).alias("chunk"))
    left = old.join(new.select("doc_id").distinct(), "doc_id", "left_anti")
    return new.union(left).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min("chunk").alias("first_chunk"))


@query(
    "sequenced_upserts",
    """WITH ops AS (SELECT user_id, event_id AS seq, event_type = 'error' AS purge, (event_id * 7919) % 100003 AS arrived FROM events), seen AS (SELECT *, coalesce(max(seq) OVER
    (PARTITION BY user_id ORDER BY arrived, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM ops)
    SELECT user_id, coalesce(max(CASE WHEN NOT purge THEN seq END), -1) > coalesce(max(CASE WHEN purge THEN seq END), -1) AS live, max(seq) AS last_seq,
    count(*) FILTER (WHERE seq > before)::BIGINT AS n_applied, count(*) FILTER (WHERE seq < before)::BIGINT AS n_stale FROM seen GROUP BY user_id""",
)
def sequenced_upserts(spark, d):
    """Upserts and purges that come out of order: one is applied if none with a later number has come before it."""
    ops = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("purge"), (F.col("event_id") * 7919 % 100003).alias("arrived"))
    earlier = Window.partitionBy("user_id").orderBy("arrived", "seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = ops.withColumn("before", F.coalesce(F.max("seq").over(earlier), F.lit(-1)))
    last = lambda kind: F.coalesce(F.max(F.when(F.col("purge") == kind, F.col("seq"))), F.lit(-1))
    return seen.groupBy("user_id").agg(
        (last(False) > last(True)).alias("live"), F.max("seq").alias("last_seq"), F.count_if(F.col("seq") > F.col("before")).alias("n_applied"),
        F.count_if(F.col("seq") < F.col("before")).alias("n_stale"),
    )


@query(
    "versioned_puts",
    """SELECT user_id, list_reduce(list_prepend(0::BIGINT, list(event_id % 3 ORDER BY ts, event_id)), lambda v, e: CASE WHEN e = v % 3 THEN v + 1 ELSE v END)::BIGINT AS version,
    count(*)::BIGINT - list_reduce(list_prepend(0::BIGINT, list(event_id % 3 ORDER BY ts, event_id)), lambda v, e: CASE WHEN e = v % 3 THEN v + 1 ELSE v END)::BIGINT AS n_conflicts FROM events GROUP BY user_id""",
)
def versioned_puts(spark, d):
    """A put counts only if it expects the version that is stored."""
    rows = table(spark, d, "events").withColumn("expected", F.col("event_id") % 3)

    def step(state, expected):
        version, conflicts = state
        return (version + 1, conflicts) if expected == version % 3 else (version, conflicts + 1)

    return folds.fold(rows, "user_id", ["ts", "event_id"], ["expected"], (0, 0), step, "version long, n_conflicts long")


@query(
    "budget_with_skips",
    """SELECT l_orderkey, list_reduce(list_prepend(0::BIGINT, list(c ORDER BY c DESC, l_linenumber)), lambda t, x: CASE WHEN t + x <= 12000000 THEN t + x ELSE t END)::BIGINT AS cents
    FROM (SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem) GROUP BY l_orderkey""",
)
def budget_with_skips(spark, d):
    """The dearest first; a line that does not fit is skipped, and smaller ones after it may fit."""
    rows = table(spark, d, "lineitem").withColumn("c", F.round(F.col("l_extendedprice") * 100).cast("long"))
    step = lambda state, c: (state[0] + c,) if state[0] + c <= 12_000_000 else state
    return folds.fold(rows, "l_orderkey", [F.desc("c"), "l_linenumber"], ["c"], (0,), step, "cents long")


@query(
    "spend_admissions",
    """SELECT user_id, s[1] AS spent, s[2] AS n_blocked, s[3] AS n_degraded FROM (SELECT user_id, list_reduce(list_prepend([0, 0, 0]::BIGINT[], list([c, 0, 0]::BIGINT[] ORDER BY ts, event_id)), lambda a, e:
    CASE WHEN a[1] + e[1] > 300000 THEN [a[1], a[2] + 1, a[3]] WHEN a[1] + e[1] > 240000 THEN [a[1] + e[1], a[2], a[3] + 1] ELSE [a[1] + e[1], a[2], a[3]] END) AS s
    FROM (SELECT user_id, ts, event_id, coalesce(round(value * 100), 0)::BIGINT AS c FROM events) GROUP BY user_id)""",
)
def spend_admissions(spark, d):
    """A request over the limit is blocked and holds nothing; one above the soft limit is degraded."""
    rows = table(spark, d, "events").withColumn("c", F.coalesce(F.round(F.col("value") * 100), F.lit(0)).cast("long"))

    def step(state, cents):
        spent, blocked, degraded = state
        if spent + cents > 300_000:
            return spent, blocked + 1, degraded
        return spent + cents, blocked, degraded + (spent + cents > 240_000)

    return folds.fold(rows, "user_id", ["ts", "event_id"], ["c"], (0, 0, 0), step, "spent long, n_blocked long, n_degraded long")


@query(
    "sliding_rate_limit",
    """SELECT user_id, len(s)::BIGINT AS n_allowed, n - len(s)::BIGINT AS n_rejected FROM (SELECT user_id, count(*)::BIGINT AS n, list_reduce(list([t] ORDER BY ts, event_id), lambda a, e:
    CASE WHEN len(list_filter(a, lambda x: x > e[1] - 86400000000)) < 3 THEN list_concat(a, e) ELSE a END) AS s FROM (SELECT user_id, ts, event_id, epoch_us(ts) AS t FROM events) GROUP BY user_id)""",
)
def sliding_rate_limit(spark, d):
    """At most three calls in any day; a rejected call does not count. The state is the last three that were allowed."""
    rows = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))

    def step(state, t):
        allowed, rejected, last = state
        kept = [int(x) for x in last.split(",") if x and int(x) > t - 86_400_000_000]
        return (allowed + 1, rejected, ",".join(map(str, [*kept, t]))) if len(kept) < 3 else (allowed, rejected + 1, last)

    found = folds.fold(rows, "user_id", ["ts", "event_id"], ["t"], (0, 0, ""), step, "n_allowed long, n_rejected long, last string")
    return found.drop("last")


@query(
    "first_exceeded_limit",
    """SELECT conv_id, CASE WHEN count(*) > 6 THEN 'turns' WHEN sum(length(text)) > 2000 THEN 'chars' WHEN max(length(text)) > 600 THEN 'turn_chars' ELSE 'none' END AS exceeded FROM conversations GROUP BY conv_id""",
)
def first_exceeded_limit(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"), F.max(F.length("text")).alias("m"))
    return turns.select("conv_id", F.when(F.col("n") > 6, "turns").when(F.col("c") > 2000, "chars").when(F.col("m") > 600, "turn_chars").otherwise("none").alias("exceeded"))


@query(
    "expired_and_erased",
    """SELECT CASE WHEN user_id % 50 = 0 THEN 'erased' WHEN ts < m - INTERVAL 20 DAY THEN 'expired' ELSE 'kept' END AS outcome, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS n_owners
    FROM events, (SELECT max(ts) AS m FROM events) GROUP BY 1""",
)
def expired_and_erased(spark, d):
    """Everything of some owners goes, and what is past its time."""
    events = table(spark, d, "events").select("user_id", "ts")
    rows = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("m"))))  # one row
    outcome = F.when(F.col("user_id") % 50 == 0, "erased").when(F.col("ts") < F.col("m") - F.expr("INTERVAL '20' DAY"), "expired").otherwise("kept")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_owners"))


@query(
    "data_card",
    """SELECT lang, source, count(*)::BIGINT AS n, count(DISTINCT md5(text))::BIGINT AS n_distinct, sum(length(text))::BIGINT AS chars, count(*) FILTER (WHERE length(text) < 200)::BIGINT AS n_short,
    count(quality)::BIGINT AS n_labelled, coalesce(sum(quality), 0)::BIGINT AS n_good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""",
)
def data_card(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality")
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", F.md5("text").alias("h"), F.length("text").alias("c")).join(labels, "doc_id", "left")
    return rows.groupBy("lang", "source").agg(
        F.count("*").alias("n"), F.count_distinct("h").alias("n_distinct"), F.sum("c").cast("long").alias("chars"), F.count_if(F.col("c") < 200).alias("n_short"),
        F.count("quality").alias("n_labelled"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("n_good"),
    )


@query(
    "changed_components",
    """SELECT user_id, count(*)::BIGINT AS n_changes, count(DISTINCT new)::BIGINT AS n_values FROM (SELECT user_id, props ->> '$.k' AS new, lag(props ->> '$.k') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
    WHERE old IS NOT NULL AND old <> new GROUP BY user_id""",
)
def changed_components(spark, d):
    """How often a component of a user's nested properties differs from the time before."""
    value = F.get_json_object("props", "$.k")
    rows = table(spark, d, "events").select("user_id", value.alias("new"), F.lag(value).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("old"))
    return rows.where("old <> new").groupBy("user_id").agg(F.count("*").alias("n_changes"), F.count_distinct("new").alias("n_values"))


@query(
    "jsonl_records",
    """SELECT conv_id % 10 = 3 AND turn = 0 AS bad, count(*)::BIGINT AS n, count(DISTINCT CASE WHEN conv_id % 10 = 3 AND turn = 0 THEN NULL ELSE role END)::BIGINT AS n_roles,
    coalesce(sum(CASE WHEN conv_id % 10 = 3 AND turn = 0 THEN NULL ELSE length(text) END), 0)::BIGINT AS chars FROM conversations GROUP BY 1""",
)
def jsonl_records(spark, d):
    """One record for each JSON line; a broken line becomes a row of its own, and the rest is read on."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    whole = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    line = F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") == 0), F.substring(whole, 1, 12)).otherwise(whole)
    read = rows.select(line.alias("line")).select(F.from_json("line", "conv_id long, turn long, role string, text string, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("r"))
    bad = F.col("r.broken").isNotNull()
    return read.groupBy(bad.alias("bad")).agg(
        F.count("*").alias("n"), F.count_distinct(F.when(~bad, F.col("r.role"))).alias("n_roles"), F.coalesce(F.sum(F.when(~bad, F.length("r.text"))), F.lit(0)).cast("long").alias("chars")
    )


@query(
    "chat_records",
    """SELECT conv_id, count(*)::BIGINT AS n_messages, md5('{"messages":[' || string_agg('{"role":"' || role || '","chars":' || length(text) || '}', ',' ORDER BY turn) || ']}') AS digest FROM conversations GROUP BY conv_id""",
)
def chat_records(spark, d):
    """A JSON line of all messages of a conversation, in order."""
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", "role", F.length("text").alias("chars")).alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    messages = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["chars"].alias("chars")))
    return turns.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.md5(F.to_json(F.struct(messages.alias("messages")))).alias("digest"))


@query(
    "parent_windows",
    """SELECT doc_id, p::BIGINT AS parent, count(*)::BIGINT AS n_children, sum(least(16, n - p * 64 - c * 16))::BIGINT AS n_words FROM (SELECT doc_id, n, p, unnest(generate_series(0, (ceil(least(64, n - p * 64) / 16.0) - 1)::INT)) AS c FROM
    (SELECT doc_id, n, unnest(generate_series(0, (ceil(n / 64.0) - 1)::INT)) AS p FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) AS n FROM documents) WHERE n > 0)) GROUP BY 1, 2""",
)
def parent_windows(spark, d):
    """Parents of 64 words, and children of 16 words inside each."""
    parents = chunking.word_windows(table(spark, d, "documents").select("doc_id", "text"), 64, 0).withColumnRenamed("position", "parent")
    children = parents.select("doc_id", "parent", F.explode(F.sequence(F.lit(1), F.col("n_words").cast("int"), F.lit(16))).alias("at"), "n_words")
    size = F.least(F.lit(16), F.col("n_words") - F.col("at") + 1)
    return children.groupBy("doc_id", F.col("parent").cast("long").alias("parent")).agg(F.count("*").alias("n_children"), F.sum(size).cast("long").alias("n_words"))


@query(
    "chunk_ids",
    """SELECT doc_id, t AS line, sha256(doc_id || ':' || md5(t) || ':' || (row_number() OVER (PARTITION BY doc_id, md5(t) ORDER BY i) - 1)) AS chunk_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t,
    unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)""".replace("t AS line, ", "i::BIGINT AS line, "),
)
def chunk_ids(spark, d):
    """Ids that follow from the document, the content and how often it came before: equal on every run."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).select("doc_id", (F.col("i") + 1).cast("long").alias("line"), F.md5("t").alias("h"))
    before = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("line")) - 1
    return lines.select("doc_id", "line", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "h", before.cast("string")), 256).alias("chunk_id"))


@query(
    "covering_lines",
    """WITH lines AS (SELECT doc_id, i, sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i) - n - 1 AS a, n FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS n, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)),
    spans AS (SELECT doc_id, k, k * 500 AS s, least(k * 500 + 500, length(text)) AS e FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) // 500)::INT)) AS k FROM documents))
    SELECT s.doc_id, k::BIGINT AS span, count(*)::BIGINT AS n_lines, min(i)::BIGINT AS first_line FROM spans s JOIN lines l ON l.doc_id = s.doc_id AND a < e AND a + n > s GROUP BY 1, 2""",
)
def covering_lines(spark, d):
    """Which lines overlap each span of 500 signs: a line goes to the spans that it touches, by their numbers."""
    lines = chunking.paragraphs(table(spark, d, "documents")).where("n_chars > 0")
    last = F.floor((F.col("char_start") + F.col("n_chars") - 1) / 500)
    touched = lines.select("doc_id", "position", F.explode(F.sequence(F.floor(F.col("char_start") / 500), last)).alias("span"))
    return touched.groupBy("doc_id", "span").agg(F.count("*").alias("n_lines"), (F.min("position") + 1).cast("long").alias("first_line"))
