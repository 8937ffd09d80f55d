"""Spelling variants of words by dynamic programming over sorted lists.

A list is sorted, so neighbouring words share prefixes. A word that is looked for keeps a row of its edit matrix for
each prefix of the list's current word, in a band of three cells, as more than one edit is of no use. The next word of
the list reuses the rows of the prefix it shares with the one before, and if all cells of a row exceed one edit, the
range of all words with that prefix is skipped. Many words are looked for side by side, each at its own place.

No list holds the whole vocabulary. Of two words one edit apart, the shorter of m code points, either the first m // 2
code points are equal or the last m - m // 2. So each word stands in a list of those with its first code points, and in
one, read backwards, of those with its last, for m of its own length and of one less. A list of more than LIST words is
dealt: each of its parts looks for some of its words in all of it, so no pair is lost.

Results for odd input: null and empty texts have no words; a null key is an empty text where words are damaged; repeated
rows count again; words of any length are compared whole; of forms with equal counts the smallest in code-point order
wins. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import cut, few, forget

#: Words that a counting task holds; then they are sent on, to be summed.
HELD = 200_000
#: Words of a list that is searched in one piece, words of lists that are searched together, and cells of rows held at once.
LIST, TOGETHER, CELLS = 20_000, 20_000, 1 << 21


def damaged(run: str, key: str, one_in: int) -> str:
    """run without one code point if one_in divides the crc32 of `<key>:<run>`, which also chooses the place."""
    h = zlib.crc32(f"{key}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % one_in == 0 else run


def count_words(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, one_in: int | None = None) -> DataFrame:
    """(word, n): words of `least` code points or more of all texts: runs of A-Z, a-z and U+00C0 to U+00FF, A-Z made lower.

    one_in: of a text, about each so-manieth word loses a code point (all its repeats do), as a typist loses one; None: none.
    """
    find = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}").findall

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for name, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    runs = "\n".join(find(whole or "")).encode().lower().decode()  # of bytes, only A-Z have a lower case
                    if not runs:
                        continue
                    own = Counter(runs.split("\n"))
                    if one_in:
                        for run, n in own.items():
                            if len(word := damaged(run, name or "", one_in)) >= least:
                                counts[word] += n
                    else:
                        counts.update(own)
                if len(counts) >= HELD:
                    yield sent(counts)
                    counts = Counter()
        yield sent(counts)

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lists:
    """Sorted lists of words (without the code point 0), one after another, in which the words that are asked for are looked up.

    shared: code points that all words of a word's list begin with; ask: whether a word is looked up.
    """

    def __init__(self, words: list[str], first: np.ndarray, shared: np.ndarray, ask: np.ndarray):
        self.words, self.first, self.shared, self.ask = words, first, shared, ask
        self.sizes = np.array([len(w) for w in words], np.int64)
        # Two blanks after each word: no sign of a word is equal to them.
        self.at = np.cumsum(self.sizes + 2) - self.sizes - 2
        self.flat = np.frombuffer("".join(f"{w}\0\0" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.last = np.append(first[1:], len(words))
        self.group = np.repeat(np.arange(len(first)), self.last - first)
        self.common = self._common()
        self.smaller = self._smaller()

    def _common(self) -> np.ndarray:
        """Code points that each word shares with the one before it; -1 for the first of a list."""
        n = len(self.words)
        out = self.shared[self.group].copy()
        alive = np.setdiff1d(np.arange(n), self.first)
        while len(alive):
            d = out[alive]
            same = (d < self.sizes[alive]) & (d < self.sizes[alive - 1])
            same &= self.flat[self.at[alive] + d] == self.flat[self.at[alive - 1] + d]
            alive = alive[same]
            out[alive] += 1
        out[self.first] = -1
        return np.append(out, -1)

    def _smaller(self) -> np.ndarray:
        """For each word the next one that shares less with the word before it than this does."""
        out, open_ = np.full(len(self.common), len(self.words), np.int64), []
        for i, n in enumerate(self.common.tolist()):
            while open_ and open_[-1][1] > n:
                out[open_.pop()[0]] = i
            open_.append((i, n))
        return out

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word asked for, word of its list) for all that are one edit apart; of two of one length, only the later of a list comes second."""
        asked = np.flatnonzero(self.ask)
        asked = asked[np.argsort(self.sizes[asked], kind="stable")]
        at = 0
        while at < len(asked):
            # As many as fit with their rows; the longest stands last.
            n = min(len(asked) - at, 8192)
            while n > 1 and n * 3 * (int(self.sizes[asked[at + n - 1]]) + 3) > CELLS:
                n = (n + 1) // 2
            yield self._search(asked[at : at + n])
            at += n

    def _search(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, size, least = self.at[own], self.sizes[own], self.shared[self.group[own]]
        rows = np.full((len(own), int((size - least).max()) + 3, 3), 2, np.int8)  # by code points beyond the shared ones
        rows[:, 0] = np.where(least[:, None] > 0, (1, 0, 1), (2, 0, 1))
        place, end, depth = self.first[self.group[own]].copy(), self.last[self.group[own]], least.copy()
        lane = np.arange(len(own))
        found = []
        while len(lane):
            p, d = place[lane], depth[lane]
            whole = d == self.sizes[p]
            # Words whose last row stands: is the cell of both ends one edit?
            if whole.any():
                done = lane[whole]
                beside = size[done] - self.sizes[p[whole]] + 1
                cell = rows[done, d[whole] - least[done], np.clip(beside, 0, 2)]
                hit = (cell == 1) & (beside >= 0) & (beside <= 2)
                found.append((own[done[hit]], p[whole][hit]))
            # Others go on by one code point.
            on = ~whole
            one, x, y = lane[on], p[on], d[on]
            sign, depths = self.flat[self.at[x] + y], y - least[one]
            row = rows[one, depths]
            before, here, after = (self.flat[q[one] + np.minimum(y + k, size[one])] != sign for k in (-1, 0, 1))
            a = np.minimum(row[:, 0] + before, row[:, 1] + 1)
            b = np.minimum(np.minimum(row[:, 1] + here, row[:, 2] + 1), a + 1)
            c = np.minimum(row[:, 2] + after, b + 1)
            new = np.minimum(np.stack((a, b, c), 1), 2)
            alive = new.min(1) <= 1
            rows[one[alive], depths[alive] + 1] = new[alive]
            depth[one[alive]] += 1
            # Where the row exceeds one edit, or the word has ended: to the next word that shares no more than stands.
            keep = np.where(whole, d, d + 1)
            keep[np.flatnonzero(on)[alive]] = -1
            moved = np.flatnonzero(keep >= 0)
            to, limit = p[moved] + 1, np.where(whole[moved], len(self.flat), keep[moved])
            while len(over := np.flatnonzero(self.common[to] >= limit)):
                to[over] = self.smaller[to[over]]
            who = lane[moved]
            place[who], depth[who] = to, self.common[to]
            ended = np.zeros(len(lane), bool)
            ended[moved] = to >= end[who]
            lane = lane[~ended]
        x, y = (np.concatenate(c) for c in zip(*found)) if found else (own[:0], own[:0])
        keep = (self.sizes[y] > self.sizes[x]) | (x < y)
        return x[keep], y[keep]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of words one edit apart, from rows (backwards, shorter, part, word, n, ask), the rows of a list side by side and sorted."""

    def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        words, n, ask = rows["word"].to_pylist(), rows["n"].to_numpy(), rows["ask"].to_numpy(zero_copy_only=False)
        back, shorter, parts = rows["backwards"].to_numpy(zero_copy_only=False), rows["shorter"].to_numpy().astype(np.int64), rows["part"].to_numpy()
        half = shorter // 2
        shared = np.where(back, shorter - half, half)
        begins = [0]
        names = [(bool(b), int(m), int(part), w[:k]) for b, m, part, w, k in zip(back, shorter, parts, words, shared.tolist())]
        begins += [i for i in range(1, len(names)) if names[i] != names[i - 1]]
        first = np.array(begins, np.int64)
        for x, y in Lists(words, first, shared[first], ask).near():
            pairs = [(words[i], words[j], i, j) for i, j in zip(x.tolist(), y.tolist())]
            # Backwards only what the forward lists don't find.
            pairs = [p for p in pairs if not back[p[2]] or p[0][::-1][: half[p[2]]] != p[1][::-1][: half[p[2]]]]
            turned = [(u[::-1], v[::-1]) if back[i] else (u, v) for u, v, i, _ in pairs]
            counts = ([int(n[i]) for _, _, i, _ in pairs], [int(n[j]) for _, _, _, j in pairs])
            yield pa.record_batch([pa.array([u for u, _ in turned], pa.string()), pa.array(counts[0], pa.int64()), pa.array([v for _, v in turned], pa.string()), pa.array(counts[1], pa.int64())], ["u", "n_u", "v", "n_v"])

    held: list[pa.RecordBatch] = []
    waiting = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        waiting += batch.num_rows
        if waiting < TOGETHER:
            continue
        rows = pa.Table.from_batches(held)
        # The last list may go on in the next batch.
        names = [rows[c].to_numpy(zero_copy_only=False) for c in ("backwards", "shorter", "part", "list")]
        same = np.logical_and.reduce([c == c[-1] for c in names])
        end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if end:
            yield from search(rows.slice(0, end))
        held, waiting = rows.slice(end).to_batches(), rows.num_rows - end
    if held:
        yield from search(pa.Table.from_batches(held))


def near_words(vocabulary: DataFrame, most: int = LIST) -> DataFrame:
    """(u, n_u, v, n_v): each pair of words of (word, n) that are one inserted, deleted or replaced code point apart, once.

    Words must be distinct and have three code points or more.
    """
    size = F.length("word")

    def row(backwards: bool, shorter, ask: bool):
        half = F.floor(shorter / 2).cast("int")
        word = F.reverse("word") if backwards else F.col("word")
        return F.struct(
            F.lit(backwards).alias("backwards"), shorter.alias("shorter"), F.substring(word, F.lit(1), (shorter - half) if backwards else half).alias("list"),
            word.alias("word"), F.col("n"), F.lit(ask).alias("ask"),
        )

    # Pairs of a list of words of m and m + 1 code points: those of m are looked up, so each pair is found in one list of each kind.
    rows = vocabulary.select(F.explode(F.array(*[row(b, m, ask) for b in (False, True) for m, ask in ((size, True), (size - 1, False))])).alias("r")).select("r.*")
    name = ["backwards", "shorter", "list"]
    large = few(cut(rows.groupBy(*name).count().where(F.col("count") > most).withColumn("parts", F.ceil(F.col("count") / most).cast("int")).drop("count")))
    rows = rows.join(large, name, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("ask", F.col("ask") & (F.pmod(F.xxhash64("word"), F.col("parts")) == F.col("part")))
    order = [*name, "part"]
    lists = rows.select(*order, "word", "n", "ask").repartition(*order).sortWithinPartitions(*order, "word")
    return lists.mapInArrow(_searched, "u string, n_u long, v string, n_v long")


def spelling_groups(vocabulary: DataFrame, ratio: int = 10, most: int = LIST) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of each word of (word, n).

    form: the near word of largest n, if that is at least ratio * n; root: the last word that forms lead to.
    """
    pairs = cut(near_words(vocabulary, most))
    both = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("word"), F.col("v").alias("other"), F.col("n_v").alias("m")), F.struct(F.col("v").alias("word"), F.col("u").alias("other"), F.col("n_u").alias("m")))).alias("r")).select("r.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form"))).alias("best"))
    led = -F.col("best.m") >= ratio * F.col("n")
    rows = vocabulary.select("word", "n").join(best, "word", "left")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("best.form")).alias("form"), F.when(led, -F.col("best.m")).alias("form_n")))
    forget(pairs)
    # Each step at least multiplies n by the ratio, so the rounds are few: ways double until none grows.
    ways = cut(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        longer = ways.join(ways.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        longer = cut(longer.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("grew")))
        forget(ways)
        ways = longer
        if ways.where("grew").isEmpty():
            break
        ways = longer.drop("grew")
        ways._cut_path = longer._cut_path
    return rows.join(ways.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
