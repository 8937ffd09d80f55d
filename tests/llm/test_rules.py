"""Isolation rules, spelling groups and token alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from quern.llm import alignment, isolation, spelling
from quern.llm.queries import QUERIES

from ..conftest import SF
from .helpers import empty, odd


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(hit)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_base_statistics(texts):
    r = random.Random(1)
    made = ["".join(r.choice(["a", "b ", "a b c ", "\n", " \x0b", "#", "é ", " ", "|x\r\n"]) for _ in range(r.randint(0, 60))) for _ in range(500)]
    for text in [*made, *(t for _, t in texts), None, ""]:
        assert isolation.statistics(text)[0] == plain_statistics(text)


def test_forest_scores_follow_paths():
    rows = np.random.default_rng(3).normal(size=(600, 3))
    forest = isolation.grow(rows, trees=20, subsample=64)

    def length(node, x):
        if forest.feature[node] < 0:
            return forest.length[node]
        return length(forest.child[node] + (x[forest.feature[node]] > forest.bound[node]), x)

    x = np.vstack((rows[:50], [[9, 9, 9], [0, 0, 0]]))
    plain = [2 ** (-np.mean([length(root, v) for root in forest.roots]) / isolation.usual_length(64)) for v in x]
    assert np.allclose(forest.scores(x), plain)
    assert plain[-2] > 0.6 > 0.5 > plain[-1]
    assert len(isolation.grow(np.zeros((0, 3))).roots) == 0 and isolation.grow(np.zeros((5, 3))).scores(np.zeros((2, 3))).shape == (2,)


def test_threshold():
    assert isolation.threshold([(10, 1, 5)]) == isolation.threshold([]) == float("inf")
    bound = isolation.threshold([(1000, 0, 9), (1100, 1, 1), (900, 1, 999), (800, 0, 1)], rejected=0.01)
    assert 900 * isolation.STEP < bound < 1000 * isolation.STEP


def test_isolation_rules_on_held_out(spark, texts):
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op11_isolation_rules"](spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, False), 0) + n.get((0, True), 0)) > 0
    assert n.get((1, False), 0) <= 0.05 * n[1, True]


def test_isolation_rules_of_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1), (7, 0), (7, 1), (None, 0), (4, None)], "doc_id long, quality int")
    rows = odd(spark).withColumn("Kept", F.lit("x"))
    found = isolation.judged(rows, labels)
    assert found.columns.count("kept") == 1 and "Kept" not in found.columns and "lang" in found.columns
    told = {r.doc_id: r for r in found.collect()}
    assert found.count() == 11 and not told[1].kept and told[2].n_words == 0 and told[7].base_failed and not told[7].kept
    assert told[7].n_repeat_words == 60_000 and isolation.judged(empty(spark), labels).count() == 0
    assert isolation.judged(rows, labels.limit(0)).where("kept = base_failed").count() == 0


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


@pytest.mark.parametrize("most", [20_000, 6])
def test_near_words(spark, most):
    r = random.Random(2)
    words = {"".join(r.choice("abé") for _ in range(r.choice((5, 6, 7, 9)))) for _ in range(250)} | {"x" * 3000, "x" * 3001, "x" * 2999 + "y"}
    found = spelling.near_words(spark.createDataFrame([(w, len(w)) for w in words], "word string, n long"), most).collect()
    assert all(row.n_u == len(row.u) and row.n_v == len(row.v) for row in found)
    pairs = [tuple(sorted((row.u, row.v))) for row in found]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(u, v) for u in words for v in words if u < v and near(u, v)}


def test_lists_skip_and_reuse():
    words = sorted(["aaaaaaab", "aaaaaaac", "aaaaaaacd", "baaaaaaa", "bbbbbbbb", "aaaaaaa"])
    found = spelling.Lists(words, np.array([0]), np.array([0]), np.ones(len(words), bool)).near()
    got = {(words[i], words[j]) for x, y in found for i, j in zip(x.tolist(), y.tolist())}
    assert got == {(u, v) for u in words for v in words if near(u, v) and (len(v) > len(u) or len(u) == len(v) and u < v)}


def test_count_words(spark, texts):
    plain = Counter()
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for key, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{key}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(run) >= 7:
                plain[run] += 1
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.count_words(rows, one_in=31).collect()} == plain


def test_spelling_of_odd_rows(spark):
    rows = odd(spark).withColumn("n", F.lit(1)).withColumn("word", F.lit("w"))
    counts = {r.word: r.n for r in spelling.count_words(rows).collect()}
    assert counts == {"epsilon": 3, "without": 1, "Ünïcödé": 1, "x" * 50_000: 1}
    assert spelling.spelling_groups(spelling.count_words(empty(spark))).count() == 0
    chain = spark.createDataFrame([("aaaaaaa", 1), ("aaaaaab", 10), ("aaaaabb", 100), ("aaaabbb", 1000), ("aaaaaba", 10)], "word string, n long")
    told = {r.word: r for r in spelling.spelling_groups(chain).collect()}
    assert told["aaaaaaa"].form == "aaaaaab" and told["aaaaaaa"].root == "aaaabbb" and told["aaaabbb"].root == "aaaabbb" and told["aaaaaaa"].n_near == 2


NAMES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(texts):
    """By the libraries and by sets of ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(NAMES[0]), sentencepiece.SentencePieceProcessor(model_file=NAMES[2])
    a.encode_special_tokens = True
    signs, vocabulary = alignment.byte_signs(), {i: t for t, i in a.get_vocab().items()}
    of_a = lambda i: bytes(signs[c] for c in vocabulary[i])
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for text in texts:
        groups = []
        if text:
            x, y = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
            if b"".join(map(of_a, x)) == b"".join(map(of_b, y)) == f" {text}".encode():
                ends_x, ends_y = (np.cumsum([len(of(i)) for i in ids]).tolist() for of, ids in ((of_a, x), (of_b, y)))
                last = 0
                for end in sorted(set(ends_x) & set(ends_y)):
                    groups.append(([i for i, e in zip(x, ends_x) if last < e <= end], [i for i, e in zip(y, ends_y) if last < e <= end]) if len(x) < 300 else None)
                    last = end
                if len(x) >= 300:  # the same in one pass
                    common, groups, p, q = set(ends_x) & set(ends_y), [], 0, 0
                    for i, e in enumerate(ends_x):
                        if e in common:
                            j = ends_y.index(e, q)
                            groups.append((x[p : i + 1], y[q : j + 1]))
                            p, q = i + 1, j + 1
        docs.append(groups)
    links = [[(i, j) for x, y in groups for i in x for j in y] for groups in docs]
    count = Counter(pair for own in links for pair in set(own))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for groups, own in zip(docs, links):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(own), digest, sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own)))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def test_alignment_query(spark, texts):
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_token_alignment"](spark, SF).collect()}
    plain = plain_alignment([t for _, t in texts])
    assert [found[k] for k, _ in texts] == plain


def test_alignment_of_odd_texts(spark, monkeypatch):
    r = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "the", "'s", "ing", "É", "漢", "🙂", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", " ", "　", "\x1c", "\x00", "\r\n", "123", "x" * 30, "ﬁ", "!?", "---", "\u0085"]
    made = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(800)] + ["▁", "a▁b", None, "", " ", "  \n ", "x" * 20_000, " " * 3_000, "a" * 9_999 + "é"]
    monkeypatch.setattr(alignment, "WRITTEN_OUT", 6)
    rows = spark.createDataFrame(list(enumerate(made)), "k long, t string").withColumn("n_a", F.lit("clash")).repartition(3)
    found = {row.k: tuple(row[c] for c in COLUMNS) for row in alignment.align_tokenizers(rows, *NAMES, "k", "t").collect()}
    assert [found[k] for k in range(len(made))] == plain_alignment(made)
    odd_rows = alignment.align_tokenizers(odd(spark), *NAMES)
    assert odd_rows.count() == 11 and odd_rows.columns[0] == "doc_id" and odd_rows.where("doc_id is null").first().n_a > 0
    assert alignment.align_tokenizers(empty(spark), *NAMES).count() == 0


@pytest.mark.parametrize("length", [1, 5, 512])
def test_runs(length):
    r = np.random.default_rng(length)
    for _ in range(200):
        end = int(r.integers(1, 400))
        x, y = (np.unique(np.append(r.integers(1, end + 1, r.integers(0, 300)), end)) for _ in range(2))
        if r.random() < 0.3:
            y = x.copy()
        common = np.intersect1d(x, y)
        ends_x, ends_y = alignment.align(x, y, length)
        assert np.array_equal(ends_x, np.searchsorted(x, common) + 1) and np.array_equal(ends_y, np.searchsorted(y, common) + 1)
    assert len(alignment.align(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0


def test_links_of_large_groups(monkeypatch):
    a, b = np.array([1, 1, 2, 3]), np.array([7, 8, 7, 9])
    ends_a, ends_b = np.array([3, 4]), np.array([3, 4])

    def counted():
        c = Counter()
        for _, i, j, n in zip(*(x.tolist() for x in alignment.linked(a, b, ends_a, ends_b))):
            c[i, j] += n
        return c

    plain = counted()
    monkeypatch.setattr(alignment, "WRITTEN_OUT", 3)
    assert counted() == plain == Counter({(1, 7): 4, (1, 8): 2, (2, 7): 2, (2, 8): 1, (3, 9): 1})
