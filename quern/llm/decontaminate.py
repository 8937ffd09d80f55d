"""Benchmark decontamination with an FM-index for each shard of the documents.

A shard is one batch of documents in a task. Words of no benchmark item cannot be inside an occurrence of a window, so
only stretches of benchmark words that are as long as the shortest window are indexed: as numbers, one after another
with a separator. The index has the suffix order's last column (the BWT) in a wavelet matrix, and every eighth suffix
position. All windows are searched backwards together; occurrences are located by walking to the next sampled
position, and become spans of document words; those that overlap are merged.

Results for odd input: null texts and texts without words have 0 words and no hits; an item without words or without id
has no window; repeated items count once for each id; a benchmark of any size is searched in blocks of items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without
from .components import cut

WINDOW = 13
#: Words of benchmark items that are searched at once: what the driver and each task hold of the benchmark.
BLOCK = 500_000
#: Words of one index.
INDEXED = 1_000_000
EVERY = 8
#: Signs that separate words: all of ASCII but digits and letters. Upper case is made lower.
TO_WORDS = bytes(b if chr(b).isalnum() and b < 0x80 or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


def suffix_array(numbers: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling the length that is compared."""
    n = len(numbers)
    rank = np.unique(numbers, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        steps = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = steps
        if steps[-1] == n - 1:
            return order
        k *= 2


class WaveletMatrix:
    """Counts how often a number occurs before a place, in as many steps as numbers have bits."""

    def __init__(self, numbers: np.ndarray, bits: int):
        self.levels = []
        for bit in reversed(range(bits)):
            ones = (numbers >> bit) & 1
            before = np.concatenate(([0], np.cumsum(ones)))
            zeros = len(numbers) - before[-1]
            self.levels.append((bit, before, zeros))
            numbers = np.concatenate((numbers[ones == 0], numbers[ones == 1]))

    def rank(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of number[i] before place at[i]."""
        start = np.zeros_like(at)
        for bit, before, zeros in self.levels:
            one = (number >> bit) & 1
            start = np.where(one, zeros + before[start], start - before[start])
            at = np.where(one, zeros + before[at], at - before[at])
        return at - start


class FmIndex:
    """Finds all places of number sequences in a sequence of positive numbers; 0 is its end."""

    def __init__(self, numbers: np.ndarray, most: int):
        numbers = np.concatenate((numbers, [0])).astype(np.int64)
        order = suffix_array(numbers)
        self.last = numbers[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(numbers, minlength=most + 1))))
        self.ranks = WaveletMatrix(self.last, max(1, int(most).bit_length()))
        self.sampled = np.where(order % EVERY == 0, order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each row of patterns."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.last), np.int64)
        alive = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            number = patterns[alive, column]
            low[alive] = self.first[number] + self.ranks.rank(number, low[alive])
            high[alive] = self.first[number] + self.ranks.rank(number, high[alive])
            alive = alive[low[alive] < high[alive]]
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes in these rows."""
        places = np.empty(len(rows), np.int64)
        walking, steps = np.arange(len(rows)), 0
        while len(walking):
            found = self.sampled[rows] >= 0
            places[walking[found]] = self.sampled[rows[found]] + steps
            walking, rows = walking[~found], rows[~found]
            number = self.last[rows]
            rows = self.first[number] + self.ranks.rank(number, rows)
            steps += 1
        return places


class Windows:
    """The windows of a block of benchmark items, as numbers of their words."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], dict[str, None]] = {}  # names in the order met, each once
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[at : at + window]), {})[item] = None
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for ids in found:
            by_length.setdefault(len(ids), []).append(ids)
        self.groups = {n: (np.array(rows, np.int64), [list(found[r]) for r in rows]) for n, rows in by_length.items()}
        self.shortest = min(by_length, default=0)

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Start and numbers of the stretches of benchmark words that a window fits in."""
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0]))))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= self.shortest:
                yield start, ids[start:end]

    def hits(self, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """Of each text: its words, the spans of occurrences (not merged) and the items they belong to."""
        number = dict.get
        n_words, spans, items = [], [[] for _ in texts], [set() for _ in texts]
        held: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []  # text and start of each stretch
        size = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            n_words.append(len(words))
            if not self.shortest:
                continue
            known = self.numbers
            ids = np.fromiter((number(known, w, 0) for w in words), np.int64, len(words))
            for start, stretch in self.stretches(ids):
                held += [stretch, [len(known) + 1]]
                owners.append((i, start))
                size += len(stretch) + 1
            if size >= INDEXED:
                self._search(held, owners, spans, items)
                held, owners, size = [], [], 0
        if held:
            self._search(held, owners, spans, items)
        return n_words, spans, items

    def _search(self, held, owners, spans, items) -> None:
        starts = np.concatenate(([0], np.cumsum([len(a) + 1 for a in held[::2]])))
        index = FmIndex(np.concatenate(held), len(self.numbers) + 1)
        for length, (patterns, names) in self.groups.items():
            low, high = index.search(patterns)
            count = high - low
            which = np.repeat(np.arange(len(patterns)), count)
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            places = index.locate(rows)
            at = np.searchsorted(starts, places, "right") - 1
            inside = places - starts[at]
            for pattern, stretch, offset in zip(which.tolist(), at.tolist(), inside.tolist()):
                text, start = owners[stretch]
                spans[text].append((start + offset, start + offset + length))
                items[text].update(names[pattern])


def blocks(benchmark: DataFrame, item: str, text: str, most: int = BLOCK) -> Iterator[list[tuple[str, str]]]:
    """The items, in blocks that hold `most` words or one item."""
    held, size = [], 0
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    for row in rows.toLocalIterator():
        held.append((row.i, row.t))
        size += len(words_of(row.t))
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(set(spans)):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


SPANS = "array<struct<start:int,end:int>>"


def _said(spans: list[list[tuple[int, int]]]) -> list[list[dict[str, int]]]:
    return [[{"start": a, "end": b} for a, b in merged_spans(s)] for s in spans]


def _search(windows: Windows):
    """The UDF that searches texts for these windows."""

    @F.pandas_udf(f"n_words long, spans {SPANS}, items array<string>")
    def searched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n_words, spans, items = windows.hits(texts.tolist())
            yield pd.DataFrame({"n_words": n_words, "spans": _said(spans), "items": [sorted(x) for x in items]})

    return searched


def _merge():
    """The UDF that merges the spans that several blocks have found."""

    @F.pandas_udf(SPANS)
    def merged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(_said([[(x["start"], x["end"]) for x in row] for row in rows]))

    return merged


def decontaminate(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, one_in: int = 20,
) -> DataFrame:
    """df with n_words, spans (of words, merged), n_hit, items and contaminated; columns with these names are replaced.

    contaminated: there is a hit, and one_in * n_hit >= n_words. Of a benchmark of several blocks, the driver and each
    task hold one at a time: what the block before has found is written before the next one is read.
    """
    out, found = without(df.withColumn("__text", F.col(text)), "n_words", "spans", "n_hit", "items", "contaminated"), []
    for block in blocks(benchmark, item, item_text):
        out = cut(out) if found else out
        found.append(f"__found{len(found)}")
        out = out.withColumn(found[-1], _search(Windows(block, window))(F.col("__text")))
    if not found:
        found, out = ["__found0"], out.withColumn("__found0", _search(Windows([], window))(F.col("__text")))
    spans, items = (F.concat(*[F.col(f"{x}.{part}") for x in found]) for part in ("spans", "items"))
    out = out.withColumns(
        {
            "n_words": F.col("__found0.n_words"),
            "spans": F.col("__found0.spans") if len(found) == 1 else _merge()(spans),
            "items": F.array_sort(F.array_distinct(items)),
        }
    )
    out = out.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))
    return out.drop("__text", *found)
