"""Queries of text and value parts: normal forms, numbers, money, dates, names, quotes and checks.

Values as people write them are made from columns of the tables, so that what is read can be compared with what was meant.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values
from ..functions import text as tx
from ..sources.tables import table
from .registry import query


@query(
    "parsed_amounts",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN -cents ELSE cents END AS cents, CASE o_orderkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'USD' END AS currency FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders)""",
)
def parsed_amounts(spark, d):
    """Amounts written in several ways, read back as cents and currency."""
    key, cents = F.col("o_orderkey") % 5, F.round(F.col("o_totalprice") * 100).cast("long")
    plain = F.format_number(F.col("o_totalprice"), 2)
    swapped = F.translate(plain, ",.", ".,")
    said = (
        F.when(key == 0, F.concat(F.lit("$"), plain)).when(key == 1, F.concat(swapped, F.lit(" €"))).when(key == 2, F.concat(F.lit("GBP "), plain))
        .when(key == 3, F.concat(F.lit("(US$ "), plain, F.lit(")"))).otherwise(F.regexp_replace(plain, ",", " "))
    )
    rows = table(spark, d, "orders").select("o_orderkey", said.alias("said"), cents.alias("true"))
    return rows.select("o_orderkey", values.cents(F.col("said")).alias("cents"), values.currency(F.col("said")).alias("currency"))


@query(
    "parsed_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 3 AND extract(day FROM o_orderdate) <= 12 AND extract(day FROM o_orderdate) <> extract(month FROM o_orderdate) THEN NULL ELSE o_orderdate::DATE END AS day FROM orders""",
)
def parsed_dates(spark, d):
    """Dates written in several ways; day and month that could be either way round are refused."""
    key, day = F.col("o_orderkey") % 6, F.col("o_orderdate").cast("timestamp")
    formats = ("yyyy-MM-dd", "dd.MM.yyyy", "d MMMM yyyy", "dd/MM/yyyy", "MMM d, yyyy", "yyyy/MM/dd")
    said = F.coalesce(*[F.when(key == i, F.date_format(day, f)) for i, f in enumerate(formats)])
    return table(spark, d, "orders").select("o_orderkey", values.day(said).alias("day"))


@query("entity_names", "SELECT c_custkey, 'customer ' || (c_custkey % 97) AS name FROM customer")
def entity_names(spark, d):
    """Names without case, quotes, brackets, leading article and repeated blanks."""
    said = F.concat(F.lit('The  "Customer"  '), (F.col("c_custkey") % 97).cast("string"), F.lit(" (Segment "), "c_mktsegment", F.lit(")"))
    return table(spark, d, "customer").select("c_custkey", values.entity_name(said).alias("name"))


@query(
    "split_identifiers",
    r"""SELECT DISTINCT p_type, list_transform(list_filter(string_split(regexp_replace(regexp_replace(p_type || 'Part_' || p_brand, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), lambda x: lower(x))[1] AS first_part FROM part""",
)
def split_identifiers(spark, d):
    """The parts of names in snake or camel case."""
    name = F.concat("p_type", F.lit("Part_"), "p_brand")
    return table(spark, d, "part").select("p_type", F.element_at(values.identifier_parts(name), 1).alias("first_part")).distinct()


@query(
    "literals",
    r"""SELECT doc_id, len(l)::BIGINT AS n, md5(array_to_string(list_sort(l), ' ')) AS digest FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*|[A-Z]{2,}[0-9]+')) AS l FROM documents)""",
)
def literals(spark, d):
    """Numbers and ids of a text, each once: what a summary must not invent."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+(?:[.,][0-9]+)*|[A-Z]{2,}[0-9]+)"), 1)))
    return table(spark, d, "documents").select("doc_id", found.alias("l")).select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", " ")).alias("digest"))


@query(
    "unsupported_atoms",
    """SELECT conv_id, turn, len(list_filter(w, lambda x: NOT list_contains(coalesce(p, []), x)))::BIGINT AS n_unsupported, len(w)::BIGINT AS n FROM (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM
    (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[A-ZÀ-Þ][a-zà-ÿ]+')) AS w FROM conversations))""",
)
def unsupported_atoms(spark, d):
    """Names of a turn that the turn before does not have."""
    own = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-ZÀ-Þ][a-zà-ÿ]+)"), 1))
    rows = table(spark, d, "conversations").select("conv_id", "turn", own.alias("w"))
    rows = rows.withColumn("p", F.coalesce(F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>")))
    return rows.select("conv_id", "turn", F.size(F.array_except("w", "p")).cast("long").alias("n_unsupported"), F.size("w").cast("long").alias("n"))


@query(
    "stripped_comments",
    r"""SELECT page_id, len(regexp_extract_all(html, '(?s)<!--.*?-->'))::BIGINT AS n_removed, md5(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS digest FROM pages""",
)
def stripped_comments(spark, d):
    rows = table(spark, d, "pages")
    return rows.select("page_id", F.regexp_count("html", F.lit("(?s)<!--.*?-->")).cast("long").alias("n_removed"), F.md5(F.regexp_replace("html", "(?s)<!--.*?-->", "")).alias("digest"))


@query(
    "denied_texts",
    """SELECT doc_id, CASE WHEN length(text) > 20000 THEN 'too_long' WHEN regexp_matches(text, '(?i)password ?=') THEN 'password' WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 'key' WHEN length(trim(text)) < 20 THEN 'too_short' END AS reason FROM documents
    WHERE length(text) > 20000 OR regexp_matches(text, '(?i)password ?=') OR regexp_matches(text, 'AKIA[0-9A-Z]{16}') OR length(trim(text)) < 20""",
)
def denied_texts(spark, d):
    """The first of some rules that blocks a text."""
    text = F.col("text")
    reason = F.when(F.length(text) > 20000, "too_long").when(text.rlike("(?i)password ?="), "password").when(text.rlike("AKIA[0-9A-Z]{16}"), "key").when(F.length(F.trim(text)) < 20, "too_short")
    return table(spark, d, "documents").select("doc_id", reason.alias("reason")).where("reason IS NOT NULL")


@query(
    "neutralised_texts",
    r"""SELECT page_id, (length(html) - length(t))::BIGINT AS n_removed, md5(t) AS digest FROM (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<img[^>]*>|<script.*?</script>', '', 'g'), '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}\x{00AD}]', '', 'g') AS t FROM pages)""",
)
def neutralised_texts(spark, d):
    """Pages without comments, images, scripts, and signs that don't show or turn the reading direction."""
    plain = F.regexp_replace("html", r"(?s)<!--.*?-->|<img[^>]*>|<script.*?</script>", "")
    plain = F.regexp_replace(plain, r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}\x{00AD}]", "")
    rows = table(spark, d, "pages").select("page_id", F.length("html").alias("n"), plain.alias("t"))
    return rows.select("page_id", (F.col("n") - F.length("t")).cast("long").alias("n_removed"), F.md5("t").alias("digest"))


MODERATED = {"insult": "idiot|moron|stupid|scum", "credential": "password|token = ", "licence": "licen[cs]e"}


@query(
    "moderated_texts",
    "SELECT doc_id, CASE WHEN insult >= 2 THEN 'block' WHEN credential >= 1 THEN 'route' WHEN insult + licence >= 1 THEN 'flag' ELSE 'pass' END AS verdict, (insult + credential + licence)::BIGINT AS n FROM (SELECT doc_id, "
    + ", ".join(f"len(regexp_extract_all(lower(text), '{p}')) AS {k}" for k, p in MODERATED.items()) + " FROM documents)",
)
def moderated_texts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", *[F.regexp_count(F.lower("text"), F.lit(p)).alias(k) for k, p in MODERATED.items()])
    verdict = F.when(F.col("insult") >= 2, "block").when(F.col("credential") >= 1, "route").when(F.col("insult") + F.col("licence") >= 1, "flag").otherwise("pass")
    return rows.select("doc_id", verdict.alias("verdict"), (F.col("insult") + F.col("credential") + F.col("licence")).cast("long").alias("n"))


@query(
    "required_phrases",
    r"""SELECT doc_id, list_filter(['the', 'and', 'der'], lambda p: NOT contains(' ' || k || ' ', ' ' || p || ' ')) = [] AS has_all, len(list_filter(['idiot', 'license'], lambda p: contains(k, p)))::BIGINT AS n_forbidden FROM
    (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS k FROM documents)""",
)
def required_phrases(spark, d):
    """Whether the normalised text has all of some phrases, and how many forbidden ones."""
    key = tx.match_normalised(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit(" "), key, F.lit(" ")).alias("k"))
    has = lambda p: F.col("k").contains(p)
    forbidden = sum((has(p).cast("long") for p in ("idiot", "license")), F.lit(0).cast("long"))
    return rows.select("doc_id", (has(" the ") & has(" and ") & has(" der ")).alias("has_all"), forbidden.alias("n_forbidden"))


@query(
    "located_quotes",
    r"""SELECT doc_id, (strpos(k, q) > 0) AS found, strpos(k, q)::BIGINT AS place FROM (SELECT doc_id, k, substr(k, 41, 30) AS q FROM (SELECT doc_id, regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g') AS k FROM documents)) WHERE length(q) = 30""",
)
def located_quotes(spark, d):
    """Where a quote first stands in a text, whatever the case and the blanks."""
    rows = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.lower("text"), "[ \t\n\r]+", " ").alias("k"))
    rows = rows.withColumn("q", F.translate(F.regexp_replace(F.substring("k", 41, 30), " ", " \n"), "abcdefgh", "ABCDEFGH")).where(F.length(F.substring("k", 41, 30)) == 30)
    place = values.quote_place(F.col("k"), F.regexp_replace(F.lower("q"), "[ \t\n\r]+", " "))
    return rows.select("doc_id", (place > 0).alias("found"), place.cast("long").alias("place"))


@query(
    "instruction_like",
    r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, '(?i)^(note|please|you must|ignore|do not|always|licensed)')))::BIGINT AS n_paragraphs FROM documents WHERE regexp_matches(text, '(?im)^(note|please|you must|ignore|do not|always|licensed)')""",
)
def instruction_like(spark, d):
    """Paragraphs that tell a reader what to do."""
    pattern = "(?i)^(note|please|you must|ignore|do not|always|licensed)"
    found = F.size(F.filter(F.split("text", "\n"), lambda p: p.rlike(pattern))).cast("long")
    return table(spark, d, "documents").select("doc_id", found.alias("n_paragraphs")).where("n_paragraphs > 0")


@query(
    "close_numbers",
    """SELECT l_returnflag, count(*) FILTER (WHERE abs(round(l_extendedprice, 0) - l_extendedprice) <= 0.25)::BIGINT AS n_absolute, count(*) FILTER (WHERE abs(round(l_extendedprice, -2) - l_extendedprice) <= 0.001 * l_extendedprice)::BIGINT AS n_relative, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""",
)
def close_numbers(spark, d):
    """Rounded numbers that are close enough to the true ones, by absolute and by relative tolerance."""
    x = F.col("l_extendedprice")
    rows = table(spark, d, "lineitem").groupBy("l_returnflag")
    return rows.agg(F.count_if(F.abs(F.round(x, 0) - x) <= 0.25).alias("n_absolute"), F.count_if(F.abs(F.round(x, -2) - x) <= 0.001 * x).alias("n_relative"), F.count("*").alias("n"))


@query(
    "order_rules",
    """SELECT CASE WHEN n_lines IS NULL THEN 'no_lines' WHEN bad_tax > 0 THEN 'tax' WHEN abs(total - o_totalprice) > 0.01 * o_totalprice THEN 'sum' WHEN o_orderdate > first_ship THEN 'dates' ELSE 'accept' END AS outcome, count(*)::BIGINT AS n FROM orders LEFT JOIN
    (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice) AS total, count(*) FILTER (WHERE l_tax > 0.07) AS bad_tax, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""",
)
def order_rules(spark, d):
    """Rules of lines, tax, sums and dates, in a fixed order: the first that fails decides."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n_lines"), F.sum("l_extendedprice").alias("total"), F.count_if(F.col("l_tax") > 0.07).alias("bad_tax"), F.min("l_shipdate").alias("first_ship")
    )
    price = F.col("o_totalprice")
    outcome = (
        F.when(F.col("n_lines").isNull(), "no_lines").when(F.col("bad_tax") > 0, "tax").when(F.abs(F.col("total") - price) > 0.01 * price, "sum")
        .when(F.col("o_orderdate") > F.col("first_ship"), "dates").otherwise("accept")
    )
    return table(spark, d, "orders").join(lines, "o_orderkey", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "unicode_normal_forms",
    r"""SELECT doc_id, md5(regexp_replace(nfc_normalize(text), '[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{00AD}]', '', 'g')) AS digest FROM documents""",
)
def unicode_normal_forms(spark, d):
    """Texts in composed form, without signs that don't show."""
    return table(spark, d, "documents").select("doc_id", F.md5(values.composed(F.col("text"))).alias("digest"))
