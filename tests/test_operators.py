"""Operators on small tables with known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import access, duplicates, metrics, windows
from quern.streaming import events as streams


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_text_functions(spark):
    assert one(spark, tx.whitespace_normalised, " a \t b\r\n\r\n\r\n\nc ") == "a b\n\nc"
    assert one(spark, tx.match_normalised, "It's  [A] Test!") == "it s a test"
    assert one(spark, tx.cache_key, " What IS it?! ") == "what is it"
    assert one(spark, tx.dehyphenated, "exam-\nple A-\nb") == "example A-\nb"
    assert one(spark, tx.terms, "The Queries and parties, boxes; glass a1") == ["query", "party", "boxe", "glass", "a1"]
    assert one(spark, tx.token_estimate, "abcd1234é") == 4
    assert one(spark, lambda c: tx.shingles(tx.words(c), 2), "a b a b") == ["a b", "b a"]
    assert one(spark, lambda c: tx.shingles(tx.words(c), 5), "") == []


def test_access_fails_closed(spark):
    rows = [(1, "x", ["a"]), (2, "shared", ["b"]), (3, "y", ["a"]), (4, None, ["a"]), (5, "x", None), (6, "x", [])]
    df = spark.createDataFrame(rows, "id int, tenant string, acl_groups array<string>")
    assert [r.id for r in access.visible(df, "x", ["a", "b"]).collect()] == [1, 2]
    assert access.visible(df, "x", []).count() == 0
    assert access.filtered(df, any_of={"tenant": []}).count() == 0 and access.filtered(df).count() == 6


def test_minhash_pairs_of_near_copies(spark):
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(1000)}" for _ in range(200)) for _ in range(8)]
    docs = [(i, t) for i, t in enumerate(base)] + [(10 + i, t + " end") for i, t in enumerate(base)] + [(20, base[0]), (21, None), (22, " ")]
    found = duplicates.minhash_pairs(spark.createDataFrame(docs, "id int, t string"), "id", "t", 0.8).collect()
    assert {(r.a, r.b) for r in found} == {(i, 10 + i) for i in range(8)}


@pytest.mark.parametrize("size", [3, 60])
def test_minhash_groups_as_brute_force(spark, size):
    rng = random.Random(3)
    docs = {}
    for group in range(3):
        base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
        for i in range(size):
            words = list(base)
            for _ in range(rng.randrange(6)):
                words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
            docs[100 * group + i] = " ".join(words)
        docs[100 * group + 99] = docs[100 * group + size - 1]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in docs.items() for w in [t.split()]}
    root = {i: i for i in docs}
    for a, b in itertools.combinations(sorted(docs), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    df = spark.createDataFrame([*docs.items(), (900, None), (901, " ")], "id int, t string")
    found = {r.id: r for r in duplicates.minhash_groups(df, "id", "t", 0.8).collect()}
    assert {i: r.component_id for i, r in found.items()} == root | {900: 900, 901: 901}
    assert all(found[i].class_id == min(j for j in docs if docs[j] == docs[i]) for i in docs)
    pairs = {(r.a, r.b) for r in duplicates.minhash_pairs(df, "id", "t", 0.8).collect()}
    linked = {i for i, r in found.items() if i == r.class_id}
    low = {i: i for i in linked}  # the pairs alone connect the classes of each component
    for _ in range(len(linked)):
        new = dict(low)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            break
        low = new
    assert all(low[i] == found[i].component_id for i in linked)


def test_minhash_moves_hashes_and_what_can_be_similar(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(300)]
    # Sets that share a third of their shingles meet in bands, and few of them can be similar.
    docs = [(i, " ".join(base[:180] + [f"x{rng.randrange(10**6)}" for _ in range(120)])) for i in range(60)]
    docs += [(100 + i, t + " end") for i, t in docs[:3]] + [(200, docs[5][1])]
    seen = []
    monkeypatch.setattr(duplicates, "written", lambda df, write=duplicates.written: seen.append(write(df)) or seen[-1])
    found = duplicates.minhash_pairs(spark.createDataFrame(docs, "id int, t string"), "id", "t", 0.8, bands=64, rows=1).collect()
    assert {(r.a, r.b) for r in found} == {(i, 100 + i) for i in range(3)}
    assert not any("string" in kind for df in seen for _, kind in df.dtypes)
    compared = [df.count() for df in seen if df.columns == ["a", "b", "n"]]
    assert len(compared) == 2 and compared[1] < 100


def test_sketches_differ_in_no_more_than_sets():
    rng = random.Random(6)
    for n in (1, 30, 400, 3000):
        one = {rng.randrange(duplicates.PRIME) for _ in range(n)}
        other = set(list(one)[: n // 2]) | {rng.randrange(duplicates.PRIME) for _ in range(n // 3)}
        bits = [duplicates._sketch(duplicates.np.array(sorted(s), dtype=int)) for s in (one, other)]
        differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in bits[0] ^ bits[1]) if other else 0
        assert differ <= len(one ^ other) and (n != 30 or differ > 10)


def test_as_of_and_islands(spark):
    rng = random.Random(2)
    left = [(i, rng.randrange(5), rng.randrange(100)) for i in range(60)]
    right = [(k, t, 1000 * k + t) for k, t in itertools.product(range(5), rng.sample(range(100), 12))]
    a, b = spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int")
    found = {r.id: r.v2 for r in windows.as_of(a, b, ["k"], "t", "v", "v2").collect()}
    assert found == {i: max((v for kk, tt, v in right if kk == k and tt <= t), default=None) for i, k, t in left}
    times = spark.createDataFrame([(1, s) for s in (0, 5, 6, 30, 31, 100)], "k int, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.island for r in windows.islands(times, ["k"], "ts", 10).orderBy("s").collect()] == [1, 1, 1, 2, 2, 3]


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(0.95, 1, 1), (0.9, 1, 1), (0.55, 0, 1), (0.4, 1, 0), (0.1, 0, 0)], "score double, y int, said int")
    sweep = {r.step: (r.tp, r.fp, r.fn, r.tn) for r in metrics.threshold_sweep(rows, "score", "y", 10).collect()}
    assert sweep[5] == (2, 1, 1, 1) and sweep[0] == (3, 2, 0, 0) and sweep[9] == (2, 0, 1, 2) and sweep[10] == (0, 0, 3, 2)
    assert metrics.kappa(rows, "y", "said").first().asDict() == {"observed": 0.6, "chance": 0.52, "kappa": round(0.08 / 0.48, 6)}
    report = {r.label: (r.support, r.precision, r.recall) for r in metrics.label_report(rows, "y", "said").collect()}
    assert report == {1: (3, 0.666667, 0.666667), 0: (2, 0.5, 0.5)}


@pytest.mark.parametrize("bad", [0.0, 1.0])
def test_breaker_stream(spark, tmp_path, bad):
    rows = [(1, i * 0.5, i < 25 and bad > 0) for i in range(200)]
    spark.createDataFrame(rows, "key long, at double, failed boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, at double, failed boolean").parquet(str(tmp_path / "in"))
    found = streams.run_to_end(streams.failure_windows(stream, "failed"), "append").orderBy("at").collect()
    assert [(r.at, r.state) for r in found] == ([] if not bad else [(9.5, "open"), (39.5, "probing"), (40.5, "closed")])


def test_streamed_sessions_and_repeats(spark, tmp_path):
    rows = [(i % 7, 1, i * 60) for i in range(10)] + [(100, 1, 9000), (200, 2, 90_000)]
    df = spark.createDataFrame(rows, "event_id int, user_id int, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    found = {(r.user_id, r.n) for r in streams.run_to_end(streams.sessions(stream, "10 minutes")).collect()}
    assert found == {(1, 10), (1, 1), (2, 1)}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert streams.run_to_end(streams.without_repeats(stream), "append").count() == 9


def test_entry_without_the_training_data(tmp_path):
    """A folder that only caches are left in, as deletion by git leaves it, takes no other query with it."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    for name in ("quern", "__spark_entry__.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "quern/llm", ignore_errors=True)
    (tmp_path / "quern/llm/__pycache__").mkdir(parents=True)
    code = "import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; print(len(e.queries()), 'op1_token_counts' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    n, there = said.stdout.split()
    assert int(n) > 200 and there == "False"


def test_amounts_of_many_digits(spark):
    from quern.functions import values

    assert one(spark, values.cents, "12345678901234567890123") is None and one(spark, values.cents, "USD 0000000000000000001,234.50") == 123450
