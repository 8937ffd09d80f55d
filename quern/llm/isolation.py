"""Quality rules by an isolation forest over their statistics.

Base rules fail texts of too few words or of too many repeated ones. What passes them is judged by a forest of random
trees: each splits a small subsample of labelled documents at random bounds on random statistics, so a document unlike most
ends after few splits. The score is 2 ** -(mean path length / that of a random search tree), and documents above a
threshold go. The threshold is calibrated on all labelled rows: the one that tells good from bad rows best while it
rejects few of the good ones. Texts are read once, for their statistics, which are written; all else works on these.

Results for odd input: null and empty texts have statistics of 0 and fail the base rules; very long texts and words are
read whole; repeated rows stay, each with its own verdict; rows with a null key are judged but not learned from. Without
labels of both kinds the forest rejects nothing. Columns of the table with the names of the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without
from .components import cut

#: Labelled rows that trees take their subsamples from, about: chosen by a hash of the key, the same on every run.
SAMPLED = 20_000
TREES, SUBSAMPLE = 256, 256
#: Documents of fewer words fail, and those with a larger share of repeated words.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Share of good labelled rows that the threshold may reject at most.
REJECTED = 0.002
#: Scores are counted by steps of so much when the threshold is calibrated.
STEP = 0.0005
#: The signs that the symbol rule counts.
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BLANKS = " \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that come twice or more, the first time included."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    n = len(known)
    windows = ids[:-2] * n + ids[1:-1]
    if n >= 1 << 21:  # three numbers would not fit in one
        windows = np.unique(windows, return_inverse=True)[1]
    windows = windows * n + ids[2:]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(windows, twice))
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """Base statistics of a whole text, and the features that the forest splits on."""
    if not text:
        return (0,) * len(BASE), (0.0,) * len(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at ASCII blanks alone
    n = len(words)
    chars = len(text) - sum(map(text.count, _BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = repeated_words(words)
    base = (n, chars, symbols, len(lines) - len(set(lines)), repeated)
    if not n:
        return base, (0.0,) * len(FEATURES)
    return base, tuple(math.log1p(20 * v) for v in (chars / n, symbols / n, len(set(words)) / n))


#: What the forest splits on, by a logarithm as their tails are long: statistics that don't depend on the length of a
#: text. Repetition is left to the base rules: good documents differ in it as much as bad ones do.
FEATURES = ("chars_a_word", "symbols_a_word", "distinct_words")


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: of each node the feature (-1: leaf), the bound, the child up to the bound (the next is above it), and a leaf's path length."""

    feature: np.ndarray
    bound: np.ndarray
    child: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    usual: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features: near 1 for what is split off early, below 0.5 for the usual."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            while len(inner := np.flatnonzero(self.feature[node] >= 0)):
                at = node[inner]
                node[inner] = self.child[at] + (x[rows[inner], self.feature[at]] > self.bound[at])
            total += self.length[node]
        return 2.0 ** (-total / max(len(self.roots), 1) / self.usual)


def usual_length(n: int) -> float:
    """Mean path length of a failed search in a random binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11) -> Forest:
    """A forest over rows of features. A node splits a random feature among those that differ in its rows, at a random bound."""
    random = np.random.Generator(np.random.PCG64(seed))
    nodes: list[list] = []
    roots = []
    deepest = math.ceil(math.log2(max(subsample, 2)))

    def fill(node: int, own: np.ndarray, depth: int) -> None:
        low, high = own.min(0), own.max(0)
        apart = np.flatnonzero(high > low)
        if depth >= deepest or len(own) < 2 or not len(apart):
            nodes[node] = [-1, 0.0, 0, depth + usual_length(len(own))]
            return
        f = int(random.choice(apart))
        bound = float(random.uniform(low[f], high[f]))
        at = len(nodes)
        nodes[node] = [f, bound, at, 0.0]
        nodes.extend([[], []])
        above = own[:, f] > bound
        fill(at, own[~above], depth + 1)
        fill(at + 1, own[above], depth + 1)

    for _ in range(trees if len(rows) else 0):
        roots.append(len(nodes))
        nodes.append([])
        fill(roots[-1], rows[random.permutation(len(rows))[:subsample]], 0)
    feature, bound, child, length = zip(*nodes) if nodes else ((), (), (), ())
    return Forest(np.array(feature, np.int64), np.array(bound), np.array(child, np.int64), np.array(length), np.array(roots, np.int64), max(usual_length(min(subsample, len(rows))), 1.0))


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base statistics, base_failed, and __features, an array; columns of df with the names of results are replaced."""

    @F.arrow_udf(T.StructType([*(T.StructField(n, T.LongType()) for n in BASE), T.StructField("features", T.ArrayType(T.DoubleType()))]))
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                base, features = zip(*map(statistics, batch.slice(at, 256).to_pylist()))
                yield pa.StructArray.from_arrays([*map(lambda c: pa.array(c, pa.int64()), zip(*base)), pa.array(features, pa.list_(pa.float64()))], [*BASE, "features"])

    out = without(df.withColumn("__told", told(F.col(text))), *BASE, "base_failed", "kept", "anomaly")
    out = out.select("*", *[F.col(f"__told.{n}").alias(n) for n in BASE], F.col("__told.features").alias("__features")).drop("__told")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def with_anomaly(df: DataFrame, forest: Forest) -> DataFrame:
    """df with anomaly, the forest's score of __features."""

    @F.arrow_udf(T.DoubleType())
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(FEATURES))
            yield pa.array(forest.scores(x))

    return df.withColumn("anomaly", scored(F.col("__features")))


def threshold(counts: list[tuple[int, int, int]], rejected: float = REJECTED) -> float:
    """The score above which documents go, from (step, label, rows) of labelled rows: the largest difference of the shares
    of bad and good rows above it, if at most `rejected` of the good ones are; infinite without rows of both labels."""
    total = [sum(n for _, label, n in counts if label == k) for k in (0, 1)]
    if not all(total):
        return math.inf
    best, found, above = 0.0, math.inf, [0, 0]
    for step in sorted({s for s, _, _ in counts}, reverse=True):
        for s, label, n in counts:
            if s == step:
                above[label] += n
        gain = above[0] / total[0] - above[1] / total[1]
        if above[1] <= rejected * total[1] and gain > best:
            best, found = gain, (step - 0.5) * STEP
    return found


def judged(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sampled: int = SAMPLED) -> DataFrame:
    """df without its text, with the base statistics, base_failed, anomaly and kept (false if base_failed or an anomaly).

    labels: rows of key and label (1: good, 0: bad) that may be learned from; a key with both labels is good.
    """
    rows = cut(with_statistics(df, text).drop(text))
    told = labels.select(F.col(key).alias("__id"), F.col(label).cast("int").alias("__y")).where("__y in (0, 1)").groupBy("__id").agg(F.max("__y").alias("__y"))
    # What passes the base rules is learned from and calibrated on; only statistics meet the labels.
    known = cut(rows.where("not base_failed").join(told, F.col(key) == F.col("__id")).select("__id", "__y", "__features"))
    n = known.count()
    few = known if n <= sampled else known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1_000_000 * sampled / n))
    sample = np.array(sorted(r[0] for r in few.select("__features").collect()), np.float64).reshape(-1, len(FEATURES))
    forest = grow(sample)
    steps = with_anomaly(known, forest).groupBy(F.round(F.col("anomaly") / STEP).cast("int").alias("s"), "__y").count()
    bound = threshold([tuple(r) for r in steps.collect()])
    out = with_anomaly(rows, forest).drop("__features")
    return out.withColumn("kept", ~F.col("base_failed") & (F.round(F.col("anomaly") / STEP) * STEP <= bound))
