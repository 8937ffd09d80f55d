"""Search for phrases, beginnings of words and their combinations by an index of positions.

The index has a row for each term of a document, with the places where it stands. It is written sorted by term, so a
term or all terms with one beginning are a range of it: a search reads only the parts of the files that may hold its
range. A phrase is found where the places of its words, each shifted by its place in the phrase, meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import pieces, written

#: Words are of ASCII letters (made lower) and digits, and of all signs beyond ASCII.
BETWEEN = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Parts that one term's rows are dealt to, so that the most frequent term fills no task.
DEALT = 32
#: Signs of text, and places of a search, that one task holds, about.
SIGNS, PLACES = 8_000_000, 500_000

Clause = tuple[str, str]


def positions(df: DataFrame, key: str = "doc_id", text: str = "text", salt: int = DEALT) -> DataFrame:
    """The index (term, key, places) of whole texts, sorted by term; places are counted from 1. Null texts have no terms."""
    n = pieces(df.sparkSession, df.agg(F.sum(F.length(text))).first()[0], SIGNS)
    words = F.filter(F.split(F.lower(F.col("text")), BETWEEN), lambda w: w != "")
    # Texts are dealt by document, so that a task groups the words of its share without another shuffle.
    texts = df.select(F.col(key), F.col(text).alias("text")).repartition(n, key)
    rows = texts.select(F.col(key), F.posexplode(words).alias("at", "term"))
    index = rows.groupBy("term", key).agg(F.array_sort(F.collect_list((F.col("at") + 1).cast("long"))).alias("places"))
    dealt = index.repartitionByRange(n, F.col("term"), F.pmod(F.xxhash64(key), F.lit(max(salt, n))))
    return written(dealt.sortWithinPartitions("term"))


def _range(word: str) -> Column:
    """The terms that a word of a phrase asks for; those with one beginning stand side by side."""
    if not word.endswith("*"):
        return F.col("term") == word
    begin = word[:-1]
    return F.col("term").startswith(begin) & (F.col("term") >= begin)


def search(index: DataFrame, searches: list[tuple[int, list[Clause]]], key: str = "doc_id") -> DataFrame:
    """(query_id, key, n_matches): documents that hold every `must` clause and no `not` clause, and match at all.

    searches: of each id its clauses, ("must" | "should" | "not", up to 62 words in a row; a word may end in * for any ending).
    n_matches: at how many places its must and should clauses match. A search without such clauses finds nothing.
    """
    parts = [(q, i, kind, len(said.split()), j, word) for q, clauses in searches for i, (kind, said) in enumerate(clauses) for j, word in enumerate(said.lower().split(), 1)]
    if any(kind not in ("must", "should", "not") for _, _, kind, *_ in parts):
        raise ValueError("a clause is must, should or not")
    if any(n > 62 for _, _, _, n, *_ in parts):
        raise ValueError("a phrase has 62 words at most")
    kind = T._parse_datatype_string("query_id int, clause int, kind string, n int, j int, word string")
    asked = index.sparkSession.createDataFrame(parts, kind)
    wanted = sorted({word for *_, word in parts})
    # One pass over the ranges of all words, which the files' statistics leave out from what is read.
    ranges = reduce(lambda a, b: a | b, [_range(w) for w in wanted]) if wanted else F.lit(False)
    told = F.array(*[F.when(_range(w), F.lit(w)) for w in wanted]) if wanted else F.array(F.lit("")).cast("array<string>")
    hits = index.where(ranges).select(key, "places", F.explode(F.filter(told, lambda w: w.isNotNull())).alias("word"))
    # Hits are dealt by document, all of whose places meet in one task; a task has about as many on larger tables.
    times = asked.groupBy("word").agg(F.count("*").alias("parts"))
    total = hits.join(F.broadcast(times), "word").agg(F.sum(F.size("places") * F.col("parts"))).first()[0]
    hits = hits.repartition(pieces(index.sparkSession, total, PLACES), key)
    hits = hits.join(F.broadcast(asked), "word")  # a row for each word of the stated searches
    shifted = hits.select("query_id", "clause", "kind", "n", key, "j", F.explode("places").alias("at"))
    # Places of one word of a clause are few in a document; words with one beginning may meet at one place once only.
    whole = shifted.groupBy("query_id", "clause", "kind", "n", key, (F.col("at") - F.col("j")).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j"))).alias("seen"))
    matches = whole.where(F.bit_count("seen") == F.col("n")).groupBy("query_id", "clause", "kind", key).agg(F.count("*").alias("times"))
    musts = asked.where("kind = 'must'").groupBy("query_id").agg(F.countDistinct("clause").alias("musts"))
    per = matches.groupBy("query_id", key).agg(
        F.count_if(F.col("kind") == "must").alias("met"), F.count_if(F.col("kind") == "not").alias("refused"), F.sum(F.when(F.col("kind") == "not", 0).otherwise(F.col("times"))).alias("n_matches")
    )
    per = per.join(F.broadcast(musts), "query_id", "left")
    return per.where("met = coalesce(musts, 0) and refused = 0 and n_matches > 0").select("query_id", key, F.col("n_matches").cast("long").alias("n_matches"))
