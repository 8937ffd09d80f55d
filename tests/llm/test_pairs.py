import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import components, embeddings, jaccard_join, shingles

from .helpers import empty, odd


def roots(n, links):
    root = {i: i for i in n}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def sets_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(texts, width, num, den):
    sets = {i: sets_of(t, width) for i, t in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(texts, 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return roots(texts, links), links


def corpus(seed, groups, size):
    rng = random.Random(seed)
    texts, key = {}, 0
    passage = [f"p{i}" for i in range(14)]
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 5, 20, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, size])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts[key] = " ".join(words + (passage if rng.random() < 0.4 else []))
            key += 1
    return texts


@pytest.mark.parametrize(("width", "num", "den", "seed"), [(3, 90, 100, 1), (5, 8, 10, 2), (2, 7, 10, 3)])
def test_join_finds_all_links(spark, width, num, den, seed):
    texts = corpus(seed, 40, 60)  # groups of 60 near copies: more than a short list holds
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in jaccard_join.similar(df, width=width, num=num, den=den).collect()}
    expected, links = brute(texts, width, num, den)
    assert links
    assert {i: r.component_id for i, r in found.items()} == expected
    assert all(r.n_shingles == len(sets_of(texts[i], width)) for i, r in found.items())


@pytest.mark.parametrize(("width", "num", "den", "words"), [(3, 90, 100, 11), (5, 8, 10, 8)])
def test_join_of_short_texts_with_a_hot_passage(spark, width, num, den, words):
    texts, hot = {}, "p0 p1 p2 p3 p4 p5"
    for i in range(0, 120, 2):  # pairs of 9 and 10, or 4 and 5, shingles
        own = " ".join(f"w{i}_{k}" for k in range(words - 6))
        texts[i], texts[i + 1] = f"{hot} {own}", f"{hot} {own} end{i}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    expected, links = brute(texts, width, num, den)
    assert len(links) == 60
    assert {r.doc_id: r.component_id for r in jaccard_join.grouped(df, width=width, num=num, den=den).collect()} == expected


@pytest.mark.parametrize(("num", "den"), [(90, 100), (8, 10), (6, 10)])
@pytest.mark.parametrize("sides", [False, True])
def test_search_finds_links_that_connect_all(num, den, sides):
    rng = np.random.default_rng(5)
    least = jaccard_join.Threshold(num, den)
    for round_ in range(12):
        sets = []
        for _ in range(6):
            base = rng.integers(0, 1 << 60, rng.choice([1, 3, 12, 60]), np.int64)
            for _ in range(rng.integers(1, 40)):
                own = base[rng.random(len(base)) > rng.choice([0.0, 0.03, 0.1])]
                sets.append(np.unique(np.concatenate((own, rng.integers(0, 1 << 60, rng.integers(0, 3), np.int64)))).astype(np.uint64))
        side = rng.integers(1, 3, len(sets)) if sides else None
        pairs = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if not sides or side[a] != side[b]]
        true = [(a, b) for a, b in pairs if (k := len(np.intersect1d(sets[a], sets[b]))) and den * k >= num * (len(sets[a]) + len(sets[b]) - k)]
        found = jaccard_join.linked(sets, least, side)
        assert {(min(p), max(p)) for p in found} <= set(true)
        assert roots(range(len(sets)), found) == roots(range(len(sets)), true)


@pytest.mark.parametrize(("num", "den"), [(90, 100), (8, 10), (5, 10)])
def test_linked_sets_post_a_segment_in_common(num, den):
    rng = np.random.default_rng(9)
    least, links = jaccard_join.Threshold(num, den), 0
    for n in [*range(1, 60), 200, 999]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, np.int64))
            drop, add = rng.integers(0, max(1, n // 3), 2)
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, np.int64))))
            if den * (len(a) - drop) >= num * (n + add) and len(b):
                links += 1
                assert np.isin(*[jaccard_join.signatures(x.astype(np.uint64), least) for x in (a, b)]).any()
    assert links > 300


@pytest.mark.parametrize("piece", [1 << 20, 37, 5])
def test_shingles_are_those_of_words(monkeypatch, piece):
    monkeypatch.setattr(shingles, "PIECE", piece)
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcDE\t \x0b\n é漢\x1f\x00") for _ in range(rng.choice([0, 1, 2, 5, 9, 30, 80]))) for _ in range(800)]
    texts += ["x" * 500, "a" * 200 + " b c d", "A b C d", "a B c D"]
    for width in (1, 3, 5):
        found = list(shingles.column_sets(pa.array([None, *texts]), width))[1:]
        meaning = {}
        for text, own in zip(texts, found):
            assert len(own) == len(sets_of(text, width)) and own.tolist() == shingles.shingles(text, width).tolist()
            for h in own.tolist():  # a hash stands for the shingles that all its texts have
                meaning[h] = meaning.get(h, sets_of(text, width)) & sets_of(text, width)
        assert all(meaning.values()) and len(meaning) == len(set().union(*[sets_of(t, width) for t in texts]))


@pytest.mark.parametrize("block", [8, 1024])
def test_join_of_large_groups_below_the_threshold(spark, monkeypatch, block):
    """Near copies of one text of which few link, dealt into blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(160):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    expected, links = brute(texts, 3, 90, 100)
    assert 20 < len(set(expected.values())) < 140 and len(links) > 100
    assert {r.doc_id: r.component_id for r in jaccard_join.grouped(df, width=3, num=90, den=100).collect()} == expected


def test_sets_are_packed_and_unpacked():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 500):
        values = np.unique(rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64) << np.uint64(1))
        assert (jaccard_join._thick(jaccard_join._thin(values)) == values >> np.uint64(16)).all()


def test_sets_are_sent_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIECE", 3)
    rng = random.Random(13)
    texts = {i: " ".join(f"w{i // 4}_{k}" for k in range(30) if k != i % 4 * 29) for i in range(40)}
    rows = [*texts.items(), (7, texts[7]), (8, texts[8]), (8, texts[8])]  # rows that come again
    rng.shuffle(rows)
    expected, links = brute(texts, 3, 80, 100)
    assert links and {r.doc_id: r.component_id for r in jaccard_join.grouped(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=80, den=100).collect()} == expected


def test_rows_of_one_id_are_one_document(spark):
    rows = [(5, "a b c d e f g"), (5, "h i j k l m n"), (3, "a b c d e f g"), (9, "h i j k l m n"), (7, "o p q r")]
    found = jaccard_join.grouped(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=9, den=10).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3), (5, 3), (5, 3), (7, 7), (9, 3)]


def test_join_odd_rows(spark):
    rows = odd(spark).withColumn("Component_ID", F.lit(-1))
    out = jaccard_join.similar(rows, width=3, num=9, den=10)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "n_shingles", "component_id"])
    found = {r.doc_id: r for r in out.collect()}
    assert out.count() == rows.count()
    assert [found[i].component_id for i in (1, 2, 3, 4)] == [1, 2, 3, 4] and found[5].component_id == found[6].component_id == 5
    assert [found[i].n_shingles for i in (1, 2, 3, 4, 5, 7)] == [0, 0, 0, 1, 6, 1] and found[None].component_id is None
    assert jaccard_join.similar(empty(spark)).count() == 0
    kept = jaccard_join.one_of_each(odd(spark), width=3, num=9, den=10)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(odd(spark).where("doc_id = 6")).collect()) == [6]


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, 200), (300, 301), (300, 301)]
    df = spark.createDataFrame([*links, (None, 5), (7, None)], "a long, b long")
    found = {r.id: r.component_id for r in components.components(df).collect()}
    nodes = {x for l in links for x in l}
    assert found == roots(nodes, [(a, b) for a, b in links if a != b])
    assert components.components(df.limit(0)).count() == 0


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.4:
            base = np.array(rows[rng.integers(len(rows))][1])
            v = base + rng.normal(0, rng.choice([0.0, 0.02, 0.035, 0.05]), 64)
        else:
            v = rng.normal(0, 1, 64)
            v /= np.linalg.norm(v)
        rows.append((i, v.astype(np.float32).astype(float).tolist(), int(i % 3)))
    return rows


def brute_vectors(rows, least):
    links, counts = [], {i: 0 for i, _, _ in rows}
    for (i, a, l), (j, b, m) in itertools.combinations(rows, 2):
        if l == m and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= least:
            links.append((i, j))
            counts[i] += 1
            counts[j] += 1
    return roots([i for i, _, _ in rows], links), counts, links


@pytest.mark.parametrize("block", [1024, 16])
def test_embeddings_recall(spark, block):
    rows = vectors(7, 500)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r for r in embeddings.near_duplicates(df, block=block).collect()}
    _, counts, links = brute_vectors(rows, 0.93)
    assert all(found[i].n_links <= n for i, n in counts.items())
    assert sum(r.n_links for r in found.values()) >= 0.95 * 2 * len(links)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_embeddings_exact_for_near_copies(spark):
    base = vectors(8, 1)[0][1]
    rows = [(i, [x * (1 + 0.001 * (i % 5)) for x in base], 1) for i in range(60)] + [(100 + i, base, 2) for i in range(40)]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=8).collect()
    assert {(r.vec_id < 100, r.n_links, r.component_id) for r in found} == {(True, 59, 0), (False, 39, 100)}


def test_embeddings_of_doubles_and_labels_of_text(spark):
    """Vectors that floats can't tell apart from the limit, and labels that aren't numbers."""
    limit, e = 0.93, 1e-9
    rows = [(1, [1.0, 0.0], "a"), (2, [limit + e, float(np.sqrt(1 - (limit + e) ** 2))], "a"), (3, [1.0, 0.0], "b"), (4, [limit - e, float(np.sqrt(1 - (limit - e) ** 2))], "b"), (5, [1.0, 0.0], "c d")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, tables=64, directions=1).collect()}
    assert found == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def test_embeddings_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 1.0], 1), (5, [float("nan"), 1.0, 1.0], 1), (6, [float("inf"), 1.0, 1.0], 1)]
    rows += [(7, v, None), (8, v, None), (9, v, 2), (9, v, 2), (None, v, 2), (10, v, 3), (11, [1.0, 2.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = embeddings.near_duplicates(df).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in out) == sorted([*((i, 0) for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11)), (9, 1), (9, 1)])
    assert all(r.component_id == r.vec_id for r in out)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_one_of_repeated_ids_is_the_same_in_any_order(spark):
    rows = [(1, f"text {i} of one id", "en", "s", i) for i in range(7)] * 2 + [(2, "another", "en", "s", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [sorted(map(tuple, jaccard_join.one_of_each(df.repartition(n, "n_chars")).collect())) for n in (1, 3, 5)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2
