"""Positional search against a scan of the texts."""

import random
import re

import pytest

from quern.operators import fulltext


def plain(rows, searches):
    out = {}
    for q, clauses in searches:
        for key, text in rows:
            words = [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", (text or "").lower()) if w]
            times = []
            for kind, said in clauses:
                pattern = [(p[:-1], str.startswith) if p.endswith("*") else (p, str.__eq__) for p in said.lower().split()]
                times.append((kind, sum(all(f(w, p) for w, (p, f) in zip(words[i : i + len(pattern)], pattern)) for i in range(len(words) - len(pattern) + 1))))
            n = sum(t for kind, t in times if kind != "not")
            if n and all(t for kind, t in times if kind == "must") and not any(t for kind, t in times if kind == "not"):
                out[q, key] = n
    return out


def test_search_as_a_scan(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["a", "ab", "abc", "b", "É", "c-d", "A."]) for _ in range(r.randint(0, 30)))) for i in range(120)] + [(900, None), (901, ""), (902, "ab " * 3000)]
    searches = [
        (1, [("must", "a ab")]), (2, [("should", "ab*"), ("not", "b")]), (3, [("must", "ab* a*"), ("must", "c d"), ("should", "é")]), (4, [("not", "a")]), (5, []),
        (6, [("should", "zz*")]), (7, [("must", "ab ab ab")]), (8, [("must", "A a"), ("must", "a a")]),
    ]
    index = fulltext.positions(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    found = {(x.query_id, x.doc_id): x.n_matches for x in fulltext.search(index, searches).collect()}
    assert found == plain(rows, searches) and (7, 902) in found
    assert fulltext.search(index, []).count() == 0 and fulltext.search(index.limit(0), searches).count() == 0
    with pytest.raises(ValueError):
        fulltext.search(index, [(1, [("may", "a")])])


def test_a_beginning_is_a_range_that_the_scan_prunes(spark):
    index = fulltext.positions(spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string"), "doc_id", "text")
    plan = fulltext.search(index, [(1, [("must", "al*")])])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "StringStartsWith(term,al)" in plan


def test_shares_of_a_task_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "SIGNS", 100)
    monkeypatch.setattr(fulltext, "PLACES", 100)
    rows = [(i, "a b " * 25) for i in range(40)]
    index = fulltext.positions(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert len(index.inputFiles()) > 20  # 4,000 signs, in terms that all documents have
    found = fulltext.search(index, [(1, [("must", "a b")])])
    assert {(r.doc_id, r.n_matches) for r in found.collect()} == {(i, 25) for i in range(40)}
    assert found.rdd.getNumPartitions() == 20  # 2,000 places
