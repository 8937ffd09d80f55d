"""Queries over whole documents: copies in order, chunks, positional search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fulltext, graphs, markdown, ordered_copies, splitting, windows
from ..sources.tables import pieces, table
from .registry import query


@query(
    "ordered_copies",
    r"""WITH words AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda x: x <> ''))) AS w FROM documents WHERE text IS NOT NULL),
    sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM words a JOIN words b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE c * c >= 0.81 * a.n * b.n),
    steps AS (SELECT s.doc_id AS k, list(x) FILTER (x IS NOT NULL) AS earlier FROM sizes s LEFT JOIN links ON y = s.doc_id GROUP BY s.doc_id),
    folded AS (SELECT list_reduce(list({'k': k, 'earlier': coalesce(earlier, []::BIGINT[])} ORDER BY k), lambda a, e: CASE WHEN list_has_any(a, e.earlier) THEN a ELSE list_append(a, e.k) END, []::BIGINT[]) AS kept FROM steps)
SELECT d.doc_id, (s.doc_id IS NULL OR list_contains(kept, d.doc_id)) AS kept FROM documents d LEFT JOIN sizes s USING (doc_id), folded""",
)
def ordered_copies_query(spark, d):
    """Documents that stay when each falls to an earlier one that stays and is close to it: a cosine of word sets of 0.9."""
    return ordered_copies.keep_earliest(table(spark, d, "documents"), least=0.9)


@query("recursive_chunks")
def recursive_chunks(spark, d):
    """Chunks of up to 128 tokens, sharing up to 16, cut at paragraphs, lines, sentences, words or tokens."""
    rows = splitting.recursive_chunks(table(spark, d, "documents").select("doc_id", "text"), 128, 16)
    return rows.select("doc_id", "position", "char_start", "char_end", F.md5("chunk").alias("chunk_md5"))


@query("semantic_chunks")
def semantic_chunks(spark, d):
    """Chunks of sentences, cut where neighbours differ more than in nine of ten places of the text."""
    rows = splitting.semantic_chunks(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "position", "char_start", "char_end", F.md5("chunk").alias("chunk_md5"))


@query("sentence_spans")
def sentence_spans(spark, d):
    """Sentences of every turn of a conversation, with where they stand."""
    rows = splitting.sentences(table(spark, d, "conversations").select("conv_id", "turn", "text"))
    return rows.select("conv_id", "turn", "position", "char_start", "char_end", F.md5("chunk").alias("chunk_md5"))


#: Clauses of stated searches: words in a row (a closing * begins a word), and what is asked of them.
SEARCHES = [
    (1, [("must", "the and")], ),
    (2, [("must", "of the"), ("not", "and")]),
    (3, [("should", "un*"), ("must", "the")]),
    (4, [("should", "thing*"), ("should", "the ing*")]),
    (5, [("must", "der"), ("should", "und der"), ("not", "sch*")]),
    (6, [("must", "el la que"), ]),
    (7, [("must", "no such phrase here")]),
]

_SEARCH_SQL = r"""WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS ws FROM documents),
    places AS (SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM docs),
    clauses(query_id, clause, kind, words) AS (VALUES %s),
    parts AS (SELECT query_id, clause, kind, len(words) AS n, unnest(words) AS word, unnest(generate_series(1, len(words))) AS j FROM clauses),
    met AS (
    SELECT query_id, clause, kind, n, doc_id, i - j AS at, count(DISTINCT j) AS k
    FROM parts JOIN places ON CASE WHEN right(word, 1) = '*' THEN starts_with(w, left(word, -1)) ELSE w = word END GROUP BY ALL),
    found AS (SELECT query_id, clause, kind, doc_id, count(*) AS times FROM met WHERE k = n GROUP BY ALL),
    musts AS (SELECT query_id, count(*) FILTER (kind = 'must') AS n FROM clauses GROUP BY query_id)
SELECT query_id, doc_id, sum(CASE WHEN kind = 'not' THEN 0 ELSE times END)::BIGINT AS n_matches FROM found JOIN musts USING (query_id)
GROUP BY query_id, doc_id, n HAVING count(*) FILTER (kind = 'must') = n AND count(*) FILTER (kind = 'not') = 0 AND sum(CASE WHEN kind = 'not' THEN 0 ELSE times END) > 0"""


@query("phrase_search", _SEARCH_SQL % ", ".join(f"({q}, {i}, '{kind}', {said.split()})" for q, clauses in SEARCHES for i, (kind, said) in enumerate(clauses)))
def phrase_search(spark, d):
    """Documents that hold phrases, words and beginnings of words as stated searches ask, with the number of matches."""
    index = fulltext.positions(table(spark, d, "documents"), "doc_id", "text")
    return fulltext.search(index, SEARCHES, "doc_id")


#: Lines, and pairs of parts, that one task holds, about.
LINES, PAIRS = 500_000, 1_000_000


def ordered_together(rows):
    """(a, b, count): in how many orders two parts, a < b, stand together; rows: (l_orderkey, l_partkey).

    Neither lines nor pairs are added up before they are dealt: hardly any two are equal there, so a table of a whole
    split would hold them all.
    """
    rows = rows.where("l_orderkey is not null and l_partkey is not null")
    lines = rows.repartition(pieces(rows.sparkSession, rows.count(), LINES), "l_orderkey").distinct()
    size = F.col("count").cast("double")
    total = lines.groupBy("l_orderkey").count().agg(F.sum(size * (size - 1) / 2)).first()[0]
    pairs = lines.withColumnRenamed("l_partkey", "a").join(lines.withColumnRenamed("l_partkey", "b"), "l_orderkey").where("a < b").select("a", "b")
    return pairs.repartition(pieces(rows.sparkSession, total, PAIRS), "a", "b").groupBy("a", "b").count()


@query("part_communities")
def part_communities(spark, d):
    """Communities of parts that were ordered together more than once."""
    pairs = ordered_together(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"))
    return graphs.communities(pairs.where("count >= 2"))


@query(
    "busy_time",
    """WITH rows AS (SELECT event_type, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + round(value * 60)::BIGINT AS e FROM events WHERE value >= 0),
    reached AS (SELECT *, max(e) OVER (PARTITION BY event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM rows)
SELECT event_type, count(*) AS n, sum(e - s)::BIGINT AS total, sum(greatest(0, e - greatest(s, r)))::BIGINT AS covered, max(e) - min(s) AS span,
       count(*) FILTER (r IS NULL OR s > r) AS islands FROM reached GROUP BY event_type""",
)
def busy_time(spark, d):
    """How long events of each kind last together, an event lasting as many minutes as its value; overlaps count once."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    rows = table(spark, d, "events").where("value >= 0").select("event_type", at.alias("s"), (at + F.round(F.col("value") * 60)).cast("long").alias("e"))
    return windows.covered_time(rows, "event_type", "s", "e")


_LINE = "'## Line ' || n || chr(10) || chr(10)"
_TABLE = "'| part | quantity |' || chr(10) || '|---|---|' || chr(10) || '| ' || p || ' | ' || q || ' |'"


@query(
    "order_pages",
    f"""WITH lines AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_quantity::BIGINT AS q FROM lineitem),
    sized AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n, p, q) AS i, length({_LINE}) AS heading, length({_TABLE}) AS body FROM lines),
    heads AS (SELECT o, length('---' || chr(10) || 'order: ' || o || chr(10) || 'parts: [' || string_agg(p::VARCHAR, ', ' ORDER BY n, p, q) || ']' || chr(10) || '---' || chr(10)) AS front,
              length('# Order ' || o) AS title, sum(heading + body + 2)::BIGINT AS rest, count(*) AS n_parts FROM sized GROUP BY o),
    placed AS (SELECT s.*, front + title + 2 + coalesce(sum(heading + body + 2) OVER (PARTITION BY o ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM sized s JOIN heads USING (o))
SELECT o AS order_key, 0::BIGINT AS position, 'heading' AS kind, 1 AS level, 'Order ' || o AS title, front AS char_start, front + title AS char_end, front + title + 2 + rest AS section_end, '' AS path, n_parts FROM heads
UNION ALL SELECT o, 2 * i - 1, 'heading', 2, 'Line ' || n, place, place + heading - 2, place + heading + body + 2, 'Order ' || o, n_parts FROM placed JOIN heads USING (o)
UNION ALL SELECT o, 2 * i, 'table', 0, '', place + heading, place + heading + body, place + heading + body, 'Order ' || o || ' > Line ' || n, n_parts FROM placed JOIN heads USING (o)""",
)
def order_pages(spark, d):
    """Orders written as Markdown pages with front matter, and read back: blocks, sections and the titles above them."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("long").alias("q"))
    orders = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_sort(F.collect_list(line)).alias("lines"))  # an order has few lines
    section = lambda x: F.concat(F.lit("## Line "), x["n"], F.lit("\n\n| part | quantity |\n|---|---|\n| "), x["p"], F.lit(" | "), x["q"], F.lit(" |\n\n"))
    parts = F.array_join(F.transform("lines", lambda x: x["p"].cast("string")), ", ")
    page = F.concat(F.lit("---\norder: "), "order_key", F.lit("\nparts: ["), parts, F.lit("]\n---\n# Order "), "order_key", F.lit("\n\n"), F.array_join(F.transform("lines", section), ""))
    pages = markdown.settings(orders.select("order_key", page.alias("text")))
    rows = markdown.outline(pages.withColumn("n_parts", F.size(F.col("settings")["parts"]).cast("long")).drop("settings"))
    return rows.select("order_key", "position", "kind", "level", "title", "char_start", "char_end", "section_end", F.array_join("path", " > ").alias("path"), "n_parts")
