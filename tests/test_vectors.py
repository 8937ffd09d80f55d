"""Vector indexes and diverse results against brute force; folds and graphs on made-up rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import catalog
from quern.operators import duplicates, folds, graphs, retrieval, vectors, windows
from quern.sources import tables


def rows_of(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, 16))
    return [(i, (centres[i % 12] + rng.normal(0, 0.5, 16)).tolist()) for i in range(n)]


def test_ivf_recall(spark):
    rows = rows_of(600)
    df = spark.createDataFrame([*rows, (9_999, None)], "vec_id long, embedding array<double>")
    found = vectors.ivf_search(df, df.where("vec_id % 50 = 0"), 10, lists=16, probes=6, sample=300).collect()
    units = np.array([v for _, v in rows])
    units /= np.linalg.norm(units, axis=1)[:, None]
    hits = 0
    for q in range(0, 600, 50):
        near = [i for i in np.argsort(-(units @ units[q]), kind="stable") if i != q][:10]
        hits += len(set(near) & {r.vec_id for r in found if r.query_id == q})
    assert hits >= 0.9 * 10 * 12 and all(r.rank <= 10 for r in found)
    assert vectors.ivf_search(df.limit(0), df.limit(0), 3).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_ivf_recall_of_the_query(spark, size):
    folder = f"/root/testdata/{size}"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding}
    keys = sorted(rows)
    units = np.array([rows[k] for k in keys], float)
    units /= np.linalg.norm(units, axis=1)[:, None]
    found = {}
    for r in catalog.QUERIES["ivf_search"](spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i, k in enumerate(keys):
        if k % 100 == 0:
            near = [keys[j] for j in np.argsort(-(units @ units[i]), kind="stable") if j != i][:10]
            hits, total = hits + len(found[k] & set(near)), total + len(near)
    assert hits >= 0.9 * total > 0


def test_ivf_in_blocks_is_exact_with_all_lists(spark):
    rows = [*rows_of(300), (9_999, None), (9_998, [0.0] * 16), (9_997, [float("nan")] + [1.0] * 15), (9_996, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vectors.ivf_search(df, df.where("vec_id % 50 = 0"), 5, lists=4, probes=4, block=20)
    exact = retrieval.nearest(df.where("vec_id < 9000"), df.where("vec_id < 9000 and vec_id % 50 = 0"), 5)
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 5)) for r in found.collect()) == sorted((r.query_id, r.rank, r.vec_id, round(r.score, 5)) for r in exact.collect())


def test_diverse_as_brute_force(spark):
    rows = rows_of(30, 2)
    candidates = [(1, i, float(np.round(1 - i / 40, 3)), v) for i, v in rows] + [(2, 5, 0.5, rows[5][1])]
    df = spark.createDataFrame(candidates, "query_id int, vec_id long, score double, v array<double>")
    found = {(r.query_id, r.place): r.vec_id for r in vectors.diverse(df, 4, 0.6).collect()}
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    chosen, left = [], [c for c in candidates if c[0] == 1]
    while len(chosen) < 4:
        best = max(left, key=lambda c: (0.6 * c[2] - 0.4 * max([cos(c[3], x[3]) for x in chosen], default=0), -c[1]))
        chosen.append(best)
        left.remove(best)
    assert [found[1, i] for i in range(4)] == [c[1] for c in chosen] and found[2, 0] == 5 and len(found) == 5


def test_folds_stream_over_batches(spark):
    rows = [(k, i, (i * 7 + k) % 11) for k in range(5) for i in range(300)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k long, i long, x long").repartition(7)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        found = folds.fold(df, "k", [F.desc("i")], ["x"], (0, 0), lambda s, x: (s[0] + 1, (s[1] * 3 + x) % 1009), "n long, h long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    expected = {}
    for k, _, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], -r[1])):
        n, h = expected.get(k, (0, 0))
        expected[k] = (n + 1, (h * 3 + x) % 1009)
    assert {r.k: (r.n, r.h) for r in found} == expected
    assert folds.fold(df.limit(0), "k", ["i"], ["x"], (0,), lambda s, x: s, "n long").count() == 0


def test_chains_are_followed_to_their_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(500, 501)], "parent long, child long")
    found = graphs.reachable(spark.createDataFrame([(3,)], "id long"), edges)
    assert sorted(r.id for r in found.collect()) == list(range(3, 71))


def in_turns(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    labels, changed = {n: n for n in near}, True
    while changed:
        changed = False
        for n in sorted(near):
            counts = {}
            for m in near[n]:
                counts[labels[m]] = counts.get(labels[m], 0) + 1
            best = min(counts, key=lambda x: (-counts[x], x))
            if best != labels[n] and counts[best] >= counts.get(labels[n], 0):
                labels[n], changed = best, True
    groups = {}
    for n, label in labels.items():
        groups.setdefault(label, []).append(n)
    return {n: (min(g), len(g)) for g in groups.values() for n in g}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_communities_as_in_turns(spark, seed):
    rng = np.random.default_rng(seed)
    # Groups with few links between them, a chain, and a repeated link.
    edges = [(int(g * 10 + a), int(g * 10 + b)) for g in range(4) for a, b in rng.integers(0, 10, (18, 2))] + [(int(a), int(b)) for a, b in rng.integers(0, 40, (4, 2))]
    edges += [(i, i + 1) for i in range(50, 58)] + [(50, 51), (70, 70)]
    found = graphs.communities(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: (r.community_id, r.size) for r in found} == in_turns(edges)
    assert len(found) == len({r.id for r in found}) and len({r.community_id for r in found}) > 1


def test_covered_time_as_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(s), int(s + n)) for k in ("a", "b", None) for s, n in zip(rng.integers(0, 400, 40), rng.integers(0, 30, 40))] + [("a", None, 5), ("a", 9, 3), ("c", 7, 7), ("c", 0, 1000), ("c", 300, 301), ("c", 1001, 1002)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    for bucket in (10, 100, 10_000):
        found = {r.k: tuple(r)[1:] for r in windows.covered_time(df, "k", "s", "e", bucket).collect()}
        for k in ("a", "b", None, "c"):
            own = sorted((s, e) for x, s, e in rows if x == k and s is not None and s <= e)
            covered, reached, islands = 0, None, 0
            for s, e in own:
                islands += reached is None or s > reached
                covered += max(0, e - (s if reached is None else max(s, reached)))
                reached = e if reached is None else max(reached, e)
            assert found[k] == (len(own), sum(e - s for s, e in own), covered, max(e for _, e in own) - own[0][0], islands)


def test_minhash_in_batches():
    rng = np.random.default_rng(3)
    codes, a, b = rng.integers(0, duplicates.PRIME, 37), np.array([3, 5, 7]), np.array([11, 13, 17])
    assert duplicates._least(codes, a, b, piece=5).tolist() == [min((int(c) * x + y) % duplicates.PRIME for c in codes) for x, y in zip(a.tolist(), b.tolist())]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        tables.shared_folder(Session())


def test_nearest_in_blocks_is_the_cosine_of_every_pair(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.integers(-3, 4, 8).astype(float) if i % 2 else r.normal(size=8)).tolist()) for i in range(300)] + [(1000 + i, [0.5] * 8) for i in range(60)]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [float("inf")] + [1.0] * 7), (404, [None] + [1.0] * 7), (405, [1.0] * 3), (406, []), (407, [1e200] * 8)]
    df = spark.createDataFrame([*rows, (None, [1.0] * 8)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0 or vec_id between 398 and 410")
    pairs = df.alias("v").join(asked.alias("q"), F.col("v.vec_id") != F.col("q.vec_id"))
    scores = pairs.select(F.col("q.vec_id").alias("query_id"), F.col("v.vec_id"), F.round(retrieval.cosine(F.col("q.embedding"), F.col("v.embedding")), 6).alias("score"))
    for n, block, cells in ((1, 2_000, 1 << 20), (7, 5, 300), (400, 2_000, 2_000)):
        told = [{(r.query_id, r["rank"]): (r.vec_id, str(r.score)) for r in x.collect()} for x in (retrieval.nearest(df, asked, n, block=block, cells=cells), retrieval.ranked(scores, "vec_id", n))]
        assert told[0] == told[1]
    plan = retrieval.nearest(df, asked, 7)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_pairs_of_orders_in_shares_that_do_not_grow(spark, monkeypatch):
    from quern.plans import document_queries

    monkeypatch.setattr(document_queries, "LINES", 10)
    monkeypatch.setattr(document_queries, "PAIRS", 10)
    rng = np.random.default_rng(4)
    rows = [(int(o), int(p)) for o, p in zip(rng.integers(0, 40, 160), rng.integers(0, 12, 160))] + [(1, 3), (1, 3), (None, 3), (None, 4), (2, None)]
    pairs = document_queries.ordered_together(spark.createDataFrame(rows, "l_orderkey long, l_partkey long"))
    plain = {}
    for o in range(40):
        own = sorted({p for x, p in rows if x == o and p is not None})
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                plain[a, b] = plain.get((a, b), 0) + 1
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == plain
    assert pairs.rdd.getNumPartitions() == -(-sum(plain.values()) // 10)
