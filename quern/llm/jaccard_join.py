"""N-gram Jaccard self-join by T-occurrence search.

A text's set holds the 64-bit hashes of its shingles. Texts with equal sets form one class, for which its least id
stands. Two sets link if they share T or more shingles, T depending on their sizes.

1. Meeting. The hashes fall into more segments than two sets that link can have differing shingles, so such sets have
   whole segments in common: so many, that they meet among the first few of their segments in any order that both agree
   on. The order puts segments of many shingles first, which hardly any other texts share. How many segments there are
   depends on a range of sizes; sets that can link with the next larger range post there as well.
2. Searching. Sets that post a segment in common meet at the least id among them, its head. Sets at one head are
   searched by T-occurrence (`linked`): each set is a query against the inverted lists of the others; its shortest lists
   are merged, the long ones are probed for the candidates that are left (DivideSkip), and those that reach T link.
   Heads with many sets are dealt into blocks of bounded size, and pairs of blocks are searched in different tasks.
3. The links that connect all linked sets become components.

Postings travel packed in arrays, one for each task and part. Of sets in one task that share a segment only the least
one is packed; the others follow their segment in a join, so a segment that many sets share is no large group anywhere.

Results for odd input: null and empty texts and texts without words have no shingles and are their own component; a
text of fewer words than a shingle has one shingle, its whole word sequence; rows with the same id are one document for
links, whatever their texts; a row without id has no component. Hashes have 64 bits, and 48 where sets meet: there two
texts of 500 words have different shingles of the same hash about once in 10^9 pairs of texts.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, without
from .components import components, cut, few, forget
from .shingles import column_sets, scramble, shingles

#: Sizes whose sets post in the same segments lie within this factor (or that of the threshold, if larger).
RANGE = 1.5
#: Segments beyond the least number, as a share of it: sets meet in their largest segments, not in nearly empty ones.
SPARE = 0.3
#: Sets and shingles of a block at most, but for one set.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Postings that a task packs at once, and of one row; parts of a partition, which is searched part by part.
PACKED, ROW, PARTS = 1 << 19, 128, 8
#: Shingles of one row of a set that is sent.
PIECE = 1024
#: Texts whose sets a task holds at once.
TEXTS = 512
#: DivideSkip's weight of a probe against a merge step, and postings up to which lists are merged by a heap.
PROBE, HEAP = 0.0085, 256


class Threshold:
    """The similarity num / den, and what follows from it for sizes of sets."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        starts = [1]
        while starts[-1] < 1 << 40:
            starts.append(max(int(starts[-1] * RANGE), starts[-1] * den // num + 1))
        self.starts = np.array(starts)
        self._known: dict[int, tuple[int, int]] = {}

    def overlap(self, a, b):
        """Least shared shingles of sets of sizes a and b that link."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def largest(self, n):
        """The largest size that links with size n."""
        return n * self.den // self.num

    def segments(self, size_range: int) -> tuple[int, int]:
        """Segments of a range of sizes, and of these, those that a set posts.

        Linked sets of sizes a and b, the smaller one in this range, differ in a + b - 2 T shingles, `most` at most. So
        they have all but `most` segments in common, and one of these is among the first `most` + 1 of either.
        """
        if size_range not in self._known:
            small = int(self.starts[size_range + 1]) - 1
            both = small + self.largest(small)
            sums = np.arange(max(2, both - self.num - self.den), both + 1)
            most = int((sums - 2 * self.overlap(sums, 0)).max())
            self._known[size_range] = (most + 1 + math.ceil(SPARE * most), most + 1)
        return self._known[size_range]

    def ranges(self, n: int) -> list[int]:
        """Ranges of sizes in which a set of size n posts: its own, and the one before if a set there can link with it."""
        own = int(np.searchsorted(self.starts, n, "right")) - 1
        return [own, own - 1] if own and self.largest(int(self.starts[own]) - 1) >= n else [own]


def signatures(found: np.ndarray, least: Threshold) -> np.ndarray:
    """The segments that a set posts: hashes of their range, place and shingles."""
    out = []
    mixed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scramble(found), dtype=np.uint64)))
    for size_range in least.ranges(len(found)) if len(found) else ():
        segments, posted = least.segments(size_range)
        place = ((found >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(place, np.arange(segments + 1))
        marks = scramble(np.arange(segments, dtype=np.uint64) + np.uint64(size_range << 40))
        said = scramble((mixed[edges[1:]] - mixed[edges[:-1]]) ^ marks)
        out.append(said[np.lexsort((said, -np.diff(edges)))[:posted]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _sets(width: int, least: Threshold):
    """Rows of id, size, digest of the set and its postings, from Arrow batches of id and text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes, digests, posts = [], [], []
            for found in column_sets(batch.column(1), width):
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                posts.append(signatures(found, least).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(posts, pa.binary())], ["id", "n", "g", "posts"]
            )

    return rows


def _apart(numbers: np.ndarray) -> bytes:
    """Numbers by the place of their bytes, so that the many zero bytes stand together and compress well."""
    return numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def _together(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _packed(parts: int):
    """Postings of rows (rep, posts): packed ones by part, and (s, rep) of those that follow another of this task."""

    def packed(reps: list[int], posts: list[bytes]) -> Iterator[pd.DataFrame]:
        every = np.concatenate([np.frombuffer(p, np.uint64) for p in posts])
        owner = np.repeat(np.array(reps, np.int64), [len(p) // 8 for p in posts])
        order = np.lexsort((owner, every))
        every, owner = every[order], owner[order]
        same = every[1:] == every[:-1]
        other = np.concatenate(([False], same & (owner[1:] != owner[:-1])))  # not the row of an id that comes again
        first = np.concatenate(([True], ~same))
        starts = np.flatnonzero(first)
        several = np.logical_or.reduceat(other, starts)
        least_owner = owner[starts]
        part = ((every[starts] & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[by_part], np.arange(parts + 1))
        rows = []
        for p in range(parts):
            for low in range(edges[p], edges[p + 1], ROW):  # small rows, since batches hold a number of rows
                at = by_part[low : min(low + ROW, edges[p + 1])]
                rows.append((p, _apart(every[starts[at]]) + _apart(least_owner[at]) + several[at].tobytes()))
        yield pd.DataFrame(rows, columns=["p", "data"]).assign(s=None, rep=None)
        if other.any():
            yield pd.DataFrame({"p": None, "data": None, "s": every[other].view(np.int64), "rep": owner[other]})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reps, posts, size = [], [], 0
        for batch in batches:
            for rep, post in zip(batch["rep"], batch["posts"]):
                reps.append(rep)
                posts.append(post)
                size += len(post) // 8
                if size >= PACKED:
                    yield from packed(reps, posts)
                    reps, posts, size = [], [], 0
        if size:
            yield from packed(reps, posts)

    def arrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in rows(batches):
            yield out.astype({"p": "Int64", "s": "Int64", "rep": "Int64"})

    return arrow


def _thin(values: np.ndarray) -> bytes:
    """Sorted hashes, cut to 48 bits, as steps from one to the next, byte by byte."""
    steps = np.diff(values >> np.uint64(16), prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(len(steps), 8)[:, :6].T.tobytes()


def _thick(data) -> np.ndarray:
    """The hashes, of 48 bits, that were packed."""
    steps = np.zeros((len(data) // 6, 8), np.uint8)
    steps[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def _met(parts: int):
    """Of the packed postings of a task: pairs (rep, head) of those that share a segment, packed by a part of rep, and rows
    (s, head) for the followers of segments."""

    def of_part(kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, pd.DataFrame]:
        every, owner, several = (np.concatenate(x) for x in zip(*kept))
        order = np.lexsort((owner, every))
        every, owner, several = every[order], owner[order], several[order]
        starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        head = np.repeat(owner[starts], np.diff(np.append(starts, len(every))))
        followed = starts[np.logical_or.reduceat(several, starts)]
        return np.stack((owner, head), 1)[owner != head], pd.DataFrame({"s": every[followed].view(np.int64), "head": owner[followed]})

    def packed(pairs: np.ndarray) -> pd.DataFrame:
        pairs = np.unique(pairs, axis=0)
        part = (scramble(pairs[:, 0].astype(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        pairs = pairs[np.argsort(part, kind="stable")]
        edges = np.searchsorted(np.sort(part), np.arange(parts + 1))
        cells = [(p, low, min(low + ROW, edges[p + 1])) for p in range(parts) for low in range(edges[p], edges[p + 1], ROW)]
        return pd.DataFrame({"q": [p for p, _, _ in cells], "data": [pairs[low:high].tobytes() for _, low, high in cells]}, columns=["q", "data", "s", "head"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pairs, size, part = [], 0, None
        for batch in chain(batches, [None]):
            for p, data in zip(batch["p"], batch["data"]) if batch is not None else [(None, b"")]:
                if p != part and kept:
                    own, followed = of_part(kept)
                    kept.clear()
                    pairs.append(np.unique(own, axis=0))
                    size += len(pairs[-1])
                    if len(followed):
                        yield followed.assign(q=None, data=None)[["q", "data", "s", "head"]]
                if size and (size >= PACKED or batch is None):
                    yield packed(np.concatenate(pairs))
                    pairs, size = [], 0
                part, n = p, len(data) // 17
                if n:
                    kept.append((_together(data[: 8 * n], np.uint64), _together(data[8 * n : 16 * n], np.int64), np.frombuffer(data[16 * n :], bool)))

    def whole_numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in rows(batches):
            yield out.astype({"q": "Int64", "s": "Int64", "head": "Int64"})

    return whole_numbers


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct pairs (rep, head) that were packed for the parts of this task."""
    pairs, size = np.zeros((0, 2), np.int64), 0
    held: list[np.ndarray] = []
    for batch in batches:
        for data in batch["data"]:
            held.append(np.frombuffer(data, np.int64).reshape(-1, 2))
            size += len(held[-1])
            if size > max(PACKED, 2 * len(pairs)):
                pairs = np.unique(np.concatenate((pairs, *held)), axis=0)
                held, size = [], 0
    pairs = np.unique(np.concatenate((pairs, *held)), axis=0)
    yield pd.DataFrame({"rep": pairs[:, 0], "head": pairs[:, 1]})


def _whole(width: int, piece: int):
    """Rows of id, piece of the set, its place, and a number that tells sets of one id apart, from batches of id and text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, pieces, places, numbers = [], [], [], []
            for id_, found in zip(batch.column(0).to_pylist(), column_sets(batch.column(1), width)):
                number = int(found.sum().view(np.int64))
                for k in range(0, len(found), piece):
                    ids.append(id_)
                    pieces.append(_thin(found[k : k + piece]))
                    places.append(k)
                    numbers.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.binary()), pa.array(places, pa.int64()), pa.array(numbers, pa.int64())], ["id", "z", "k", "u"])

    return rows


class Roots:
    """Which of n places are connected so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.members: dict[int, list[int]] = {}

    def join(self, a: int, b: int) -> bool:
        """Connect two places; whether they weren't connected before."""
        a, b = int(self.root[a]), int(self.root[b])
        if a == b:
            return False
        own, other = self.members.pop(a, [a]), self.members.pop(b, [b])
        if len(own) < len(other):
            a, own, other = b, other, own
        self.root[other] = a
        self.members[a] = own + other
        return True


def linked(sets: list[np.ndarray], least: Threshold, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between places of sets that connect all that link; with sides, of pairs of different sides alone.

    T-occurrence search: a set is the query, and its candidates are the sets that come after it by size, so that T grows
    with the candidate. Of the query's inverted lists, the L longest are set aside (fewer than T), and the rest are
    merged. A candidate that they leave short of T by more than L is out; the others are looked up in the long lists by
    binary search, those of the shorter lists first, and dropped as soon as they can't reach T. Candidates that earlier
    links connect with the query are left out.
    """
    size = np.array([len(s) for s in sets], np.int64)
    by_size = np.argsort(size, kind="stable")
    size = size[by_size]
    k, words = len(sets), [sets[i] for i in by_size]
    side = None if side is None else np.asarray(side)[by_size]
    values, token, lists = np.unique(np.concatenate(words) if words else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(k), size)
    order = np.argsort(token, kind="stable")
    owners = owner[order]  # the lists, one after another, each in order
    keys = token[order] * k + owners
    begin = np.concatenate(([0], np.cumsum(lists)))
    ends = np.concatenate(([0], np.cumsum(size)))
    tree, out = Roots(k), []
    for q in range(k):
        n = int(size[q])
        own = token[ends[q] : ends[q + 1]]
        length = lists[own]
        own, length = own[length > 1], length[length > 1]
        t = int(least.overlap(n, n)) if n else 1
        if len(own) < t:
            continue
        last = int(np.searchsorted(size, least.largest(n), "right"))  # candidates are q + 1 to last - 1
        if last <= q + 1:
            continue
        shortest = np.argsort(length, kind="stable")
        own, length = own[shortest], length[shortest]
        long = min(t - 1, math.ceil(t / (PROBE * math.log2(int(length[-1])) + 1)))
        short, probed = own[: len(own) - long], own[len(own) - long :]
        merged = [owners[begin[x] : begin[x + 1]] for x in short.tolist()]
        if length[: len(short)].sum() <= HEAP:
            counts = np.bincount(np.fromiter(heapq.merge(*map(np.ndarray.tolist, merged)), np.int64), minlength=k)
        else:  # the same by counting, which is faster than a heap for more
            counts = np.bincount(np.concatenate(merged), minlength=k)
        rest = counts[q + 1 : last]
        candidates = np.flatnonzero((rest > 0) & (rest + long >= t)) + q + 1
        if side is not None and len(candidates):
            candidates = candidates[side[candidates] != side[q]]
        if len(candidates):
            candidates = candidates[tree.root[candidates] != tree.root[q]]
        need = least.overlap(n, size[candidates])
        have = counts[candidates]
        for at in range(0, len(probed), 16):
            alive = have + len(probed) - at >= need
            candidates, need, have = candidates[alive], need[alive], have[alive]
            if not len(candidates):
                break
            asked = probed[at : at + 16, None] * k + candidates
            place = np.minimum(np.searchsorted(keys, asked.ravel()), len(keys) - 1)
            have = have + (keys[place].reshape(asked.shape) == asked).sum(axis=0)
        for c in candidates[have >= need].tolist():
            if tree.join(q, c):
                out.append((int(by_size[q]), int(by_size[c])))
    return out


def _searched(least: Threshold):
    """Links (a, b) among rows of sets that come sorted by head and pair of blocks."""

    def of_group(ids: list[int], pieces: list[list[np.ndarray]], sides: list[int]) -> pa.RecordBatch:
        sets = [p[0] if len(p) == 1 else np.concatenate(p) for p in pieces]
        found = linked(sets, least, np.array(sides) if any(sides) else None)
        return pa.RecordBatch.from_arrays([pa.array([ids[pair[i]] for pair in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        pieces: list[list[np.ndarray]] = []
        sides: list[int] = []
        last = row = None
        for batch in batches:
            head, i, j, id_, u, k, side = (batch.column(name).to_pylist() for name in ("head", "i", "j", "id", "u", "k", "side"))
            for *key, own, number, place, where, packed in zip(head, i, j, id_, u, k, side, batch.column("z")):
                before, row = row, (key, own, number, place)
                if before == row:
                    continue  # a row that comes again
                if key != last:
                    if len(ids) > 1:
                        yield of_group(ids, pieces, sides)
                    ids, pieces, sides, last = [], [], [], key
                if not place:
                    ids.append(own)
                    pieces.append([])
                    sides.append(where)
                pieces[-1].append(_thick(packed.as_py()))
        if len(ids) > 1:
            yield of_group(ids, pieces, sides)

    return rows


def links(texts: DataFrame, sets: DataFrame, width: int, least: Threshold) -> DataFrame:
    """Links (a, b) that connect all sets that link, from texts (id, t) and their sets (id, n, g, posts)."""
    parts = partitions(texts)
    own = sets.where("n > 0 AND id IS NOT NULL")
    copies = cut(own.groupBy("g", "n").agg(F.min("id").alias("rep")).join(own.select("id", "g", "n").distinct(), ["g", "n"]).where("id != rep").select("id", "g"))
    reps = own.join(few(copies), ["id", "g"], "left_anti").select(F.col("id").alias("rep"), "posts")
    posts = cut(reps.mapInPandas(_packed(PARTS * parts), "p long, data binary, s long, rep long"))
    met = posts.where("p is not null").select("p", "data").repartition(parts, "p").sortWithinPartitions("p")
    met = cut(met.mapInPandas(_met(parts), "q long, data binary, s long, head long"))
    pairs = met.where("q is not null").select("q", "data").repartition(parts, "q").mapInPandas(_stars, "rep long, head long")
    followers = posts.where("s is not null").select("s", "rep").join(met.where("s is not null").select("s", "head"), "s")
    stars = pairs.union(followers.select("rep", "head").where("rep != head")).distinct()
    stars = cut(stars)
    forget(posts, met, copies)

    # Each set at a head goes to every pair of blocks with its own.
    stars = stars.union(stars.select("head", "head").distinct())
    sizes = sets.where("id is not null").groupBy(F.col("id").alias("rep")).agg(F.max("n").alias("n"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    placed = cut(stars.join(sizes, "rep"))
    placed = placed.join(few(cut(placed.groupBy("head").agg(blocks.alias("blocks")).where("blocks > 1"))), "head", "left")
    placed = placed.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = cut(
        placed.select(
            F.col("rep").alias("id"), "head", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            F.when(F.col("own") == F.col("other"), 0).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(2)).alias("side"),
        )
    )
    wanted = few(cut(placed.select("id").distinct()))
    whole = texts.join(wanted, "id", "left_semi").select("id", "t").mapInArrow(_whole(width, PIECE), "id long, z binary, k long, u long")
    group = ["head", "i", "j"]
    found = whole.join(few(placed), "id").repartition(parts, *group).sortWithinPartitions(*group, "id", "u", "k")
    return found.mapInArrow(_searched(least), "a long, b long")


def grouped(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row (key, n_shingles, component_id) for each row of df: the least id that links reach, where texts link.

    key must be a long.
    """
    least = Threshold(num, den)
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    sets = cut(texts.mapInArrow(_sets(width, least), "id long, n long, g binary, posts binary"))
    found = cut(links(texts.where("id is not null"), sets, width, least))
    own = cut(sets.select("id", "n", "g"))
    forget(sets)
    # Rows of one id count as one document, whatever their texts.
    classes = own.where("n > 0 AND id IS NOT NULL").groupBy("g", "n").agg(F.min("id").alias("rep"))
    several = own.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 != g1").select("id")
    same = own.join(several, "id", "left_semi").join(classes, ["g", "n"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    reached = cut(components(found.union(same)))
    forget(found)
    classes = classes.join(few(reached), F.col("rep") == F.col("id"), "left").select("g", "n", F.coalesce("component_id", "rep").alias("c"))
    rows = own.join(classes, ["g", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """df with n_shingles and component_id: the least id that links reach, where texts of similarity num / den link.

    Columns of df with these names are replaced. key must be a long.
    """
    found = grouped(df, key, text, width, num, den).where(F.col(key).isNotNull())
    found = found.groupBy(F.col(key).alias("__id")).agg(F.min("component_id").alias("component_id"))

    @F.pandas_udf("long")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([len(shingles(t, width)) for t in batch], dtype="int64")

    rows = without(df.withColumn("__n", sizes(F.col(text))), "n_shingles", "component_id")
    rows = rows.join(found, F.col(key).cast("long") == F.col("__id"), "left").withColumnRenamed("__n", "n_shingles")
    return rows.drop("__id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of df that stay if one document of each group of similar ones does: that of the least id.

    Rows without id stay. Of several rows with one id, the one whose values have the least digest stays.
    """
    found = grouped(df, key, text, width, num, den)
    ids = found.where(F.col(key).isNotNull() & (F.col(key) != F.col("component_id"))).select(F.col(key).alias("id")).distinct()
    kept = df.join(few(cut(ids)), F.col(key) == F.col("id"), "left_anti")
    repeated = cut(kept.groupBy(key).count().where((F.col("count") > 1) & F.col(key).isNotNull()).select(F.col(key).alias("id")))
    if repeated.isEmpty():
        return kept
    twice = kept.join(repeated, F.col(key) == F.col("id"), "left_semi")
    twice = twice.withColumn("__digest", F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    least = twice.groupBy(F.col(key).alias("id")).agg(F.min("__digest").alias("least"))
    twice = twice.join(least, (F.col(key) == F.col("id")) & (F.col("__digest") == F.col("least")), "left_semi").drop("__digest").dropDuplicates([key])
    return kept.join(repeated, F.col(key) == F.col("id"), "left_anti").union(twice)
