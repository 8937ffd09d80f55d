"""Near copies in order against the sequential loop."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import ordered_copies

from .conftest import SF


def sequential(rows, least):
    sets = {i: (key, frozenset(text.lower().split())) for i, (key, text) in enumerate(rows) if key is not None and text and text.split()}
    kept, out = [], [True] * len(rows)
    for i in sorted(sets, key=lambda i: (sets[i][0], i)):
        s = sets[i][1]
        out[i] = not any(len(s & o) ** 2 >= least**2 * len(s) * len(o) - 1e-9 for o in kept)
        if out[i]:
            kept.append(s)
    return out


@pytest.mark.parametrize("small", [32, 2])
def test_as_the_sequential_loop(spark, small):
    r = random.Random(small)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(12):
        base = r.sample(words, 20)
        for _ in range(r.randint(1, 14)):  # chains of small changes
            base = base[:]
            base[r.randrange(20)] = r.choice(words)
            rows.append(" ".join(base))
    r.shuffle(rows)
    rows = [*enumerate(rows), (900, None), (901, " "), (None, "w1 w2"), (902, rows[3]), (903, "only these"), (904, "These ONLY")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).repartition(3)
    found = {r.doc_id: r.kept for r in ordered_copies.keep_earliest(df, least=0.8, small=small).collect()}
    wanted = dict(zip([k for k, _ in rows], sequential(rows, 0.8)))
    assert found == wanted and not all(wanted.values())


def test_chains_of_links(spark):
    n = 9
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(20, 21)], "a long, b long")
    none = spark.createDataFrame([], "bucket long, k long")
    told = {r.k: r.kept for r in ordered_copies.first_independent(links, none, lambda p: p).collect()}
    assert told == {**{i: i % 2 == 0 for i in range(n + 1)}, 20: True, 21: False}


def test_random_orders_of_links(spark):
    r = random.Random(4)
    edges = {tuple(sorted(r.sample(range(30), 2))) for _ in range(50)}
    expected = {}
    for k in sorted({x for e in edges for x in e}):
        expected[k] = not any(expected[a] for a, b in edges if b == k)
    # Half of the links come as buckets of two that are compared when the earlier one stays.
    given = [e for i, e in enumerate(sorted(edges)) if i % 2]
    buckets = [(i, k) for i, e in enumerate(sorted(edges)) if not i % 2 for k in e]
    told = ordered_copies.first_independent(spark.createDataFrame(given, "a long, b long"), spark.createDataFrame(buckets, "bucket long, k long"), lambda p: p)
    assert {x.k: x.kept for x in told.collect()} == expected


def test_documents_and_empty_tables(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    found = {r.doc_id: r.kept for r in ordered_copies.keep_earliest(df).collect()}
    assert found == dict(zip([k for k, _ in rows], sequential(rows, 0.9)))
    assert ordered_copies.keep_earliest(df.limit(0)).count() == 0


def test_frequent_words_of_different_texts_cost_no_rounds(spark, monkeypatch):
    n, calls = 34, []
    monkeypatch.setattr(ordered_copies, "written", lambda df, write=ordered_copies.written: calls.append(1) or write(df))
    df = spark.createDataFrame([(n * i + j, f"r{i} c{j}") for i in range(n) for j in range(n)] + [(5000, "c0 r0")], "doc_id long, text string")
    found = {r.doc_id: r.kept for r in ordered_copies.keep_earliest(df).collect()}
    assert found == {i: i != 5000 for i in [*range(n * n), 5000]} and len(calls) < 12
