"""Alignment of the tokens of two tokenizers by diagonal run skipping, and how often the corpus links their ids.

Tokens of A and B cover the same bytes. Where both end, a group ends: the tokens since the last such place are linked,
each of A with each of B. Ends of tokens are two sorted arrays. While the arrays agree at a constant shift of their
indexes, every group has one token of each: such a stretch is measured by exponential probing (windows of doubling
length) and jumped as a whole. Where they disagree, two fingers walk to the next common end, and the shift is what the
walk leaves. Many stretches of the arrays are aligned side by side; each begins at a common end, found by bisection.

Over the corpus. Documents go through the tokenizers once, in blocks of bounded size. A block has a dictionary of its
distinct id pairs, each with the number of its documents that link it; a document refers to it by place. Only
dictionaries are shuffled by pair, to be summed and sent back to their blocks, where the sums of each document follow.

Side A is merged by rank. That gives the ids of the file's list of merges if no vocabulary string has another last merge
than the one listed, which is checked offline, on the driver; a file of another kind is refused.

Results for odd input: texts that are null or empty, or whose tokens don't give back space + text (as those that hold
U+2581), have zeros and an empty digest; their rows stay. Rows with equal or null keys stay apart, and each counts as a
document. Columns other than the key and the text are not returned. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import merged
from .components import cut

MARK = "▁"
#: Bytes of text of a block, and of texts that are held as tokens at once (or one text, if it is longer).
BLOCK, SLICE = 24 << 20, 1 << 20
#: Tokens of the stretches that are aligned side by side, and of the first and the widest window of a probe.
STRETCH, NARROW, WIDE = 512, 4, 64
#: Up to so many links a group is written out; a larger one is counted by its distinct ids.
WRITTEN_OUT = 4096
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_signs() -> dict[str, int]:
    """The sign that byte-level vocabularies write for each byte: printable Latin-1 as it is, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def byte_level_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE file, if merging by id is what its merges do."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    signs, special = byte_signs(), {t["content"] for t in told["added_tokens"]}
    written = lambda token: bytes(signs[c] for c in token)
    ranks = {written(token): i for token, i in told["model"]["vocab"].items() if token not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
    last = -1
    for left, right in ((written(a), written(b)) for a, b in pairs):
        token = left + right
        lower = {t: r for t, r in ((x, ranks[x]) for x in parts_of(token) if x in ranks) if r < ranks[token]}
        if ranks[token] <= last or merged(token, lower) != [left, right]:
            raise ValueError(f"merging by id is not what the merges of {path} do")
        last = ranks[token]
    if len(pairs) + 256 != len(ranks) or told["normalizer"] or told["pre_tokenizer"]["type"] != "ByteLevel" or not told["pre_tokenizer"]["use_regex"]:
        raise ValueError(f"{path} is not plain byte-level BPE")
    return ranks


def parts_of(data: bytes) -> set[bytes]:
    """All substrings."""
    return {data[i:j] for i in range(len(data)) for j in range(i + 1, len(data) + 1)}


class Ragged:
    """Byte strings by number, that can be laid one after another for an array of numbers."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def laid(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Pair:
    """Both tokenizers: encode texts to ids, and what the ids stand for."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: str):
        import sentencepiece
        import tiktoken

        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        strings = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            strings[i] = token
        self.bytes_a = Ragged(strings)
        told = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = Ragged([bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace(MARK, " ").encode() for i, p in enumerate(told)])
        #: How ids are written before a comma and a bar (A), and before a comma and a semicolon (B).
        self.n_a, self.n_b = len(strings), len(told)
        self.names = Ragged([f"{i}{sign}".encode() for sign, n in zip(",|,;", (self.n_a, self.n_a, self.n_b, self.n_b)) for i in range(n)])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each text that has a sign; both are empty if a side's tokens don't give back space + text."""
        out = []
        none = np.zeros(0, np.int64)
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            a, b = np.array(self.a.encode_ordinary(f" {text}"), np.int64), np.array(b, np.int64)
            data = np.frombuffer(f" {text}".encode(), np.uint8)
            same = all(np.array_equal(side.laid(ids), data) for side, ids in ((self.bytes_a, a), (self.bytes_b, b)))
            out.append((a, b) if same else (none, none))
        return out


def starts(x: np.ndarray, y: np.ndarray, length: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Places in both arrays after a common end, about every `length` tokens, and 0; found by bisection."""
    at = np.arange(length - 1, len(x) - 1, length)
    there = np.searchsorted(y, x[at])
    common = y[np.minimum(there, len(y) - 1)] == x[at]
    zero = np.zeros(1, np.int64)
    return np.concatenate((zero, at[common] + 1)), np.concatenate((zero, there[common] + 1))


def align(x: np.ndarray, y: np.ndarray, length: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B up to the end of each group. x, y: ends of the tokens of A and B, the last of which is common."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = starts(x, y, length)
    stop = np.append(i[1:], len(x))
    # Beyond the arrays nothing is equal.
    x, y = np.concatenate((x, np.full(WIDE, -1))), np.concatenate((y, np.full(WIDE, -2)))
    runs = []
    while len(i):
        p, q = x[i], y[j]
        met = np.flatnonzero(p == q)
        if len(met):  # these stretches are at a common end: how far is the shift kept?
            n, probing, width = np.zeros(len(met), np.int64), np.arange(len(met)), NARROW
            while len(probing):
                window = np.arange(width)
                here = n[probing][:, None] + window
                own = met[probing][:, None]
                equal = x[i[own] + here] == y[j[own] + here]
                ahead = np.where(equal.all(1), width, equal.argmin(1))
                n[probing] += ahead
                probing = probing[(ahead == width) & (i[met[probing]] + n[probing] < stop[met[probing]])]
                width = min(2 * width, WIDE)
            n = np.minimum(n, stop[met] - i[met])
            runs.append((i[met], n, j[met] - i[met]))
            i[met] += n
            j[met] += n
        apart = np.flatnonzero(p != q)  # these walk within an irregular group
        behind = p[apart] < q[apart]
        i[apart] += behind
        j[apart] += ~behind
        on = i < stop
        if not on.all():
            i, j, stop = i[on], j[on], stop[on]
    first, n, shift = (np.concatenate(c) for c in zip(*runs))
    order = np.argsort(first)
    first, n, shift = first[order], n[order], shift[order]
    ends = np.repeat(first - np.cumsum(n) + n, n) + np.arange(1, n.sum() + 1)
    return ends, ends + np.repeat(shift, n)


def linked(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, id of A, id of B, times) of the links of groups: a row for each link, or for each distinct pair of a large group."""
    starts_a, starts_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    n_a, n_b = ends_a - starts_a, ends_b - starts_b
    large = np.flatnonzero(n_a * n_b > WRITTEN_OUT)
    each = np.repeat(np.where(n_a * n_b > WRITTEN_OUT, 0, n_b), n_a)
    at = np.repeat(np.arange(len(a)), each)
    within = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
    found = [(at, a[at], b[np.repeat(np.repeat(starts_b, n_a), each) + within], np.ones(len(at), np.int64))]
    for g in large.tolist():
        own, k = np.unique(a[starts_a[g] : ends_a[g]], return_counts=True)
        other, m = np.unique(b[starts_b[g] : ends_b[g]], return_counts=True)
        found.append((np.full(len(k) * len(m), starts_a[g]), np.repeat(own, len(m)), np.tile(other, len(k)), np.repeat(k, len(m)) * np.tile(m, len(k))))
    return tuple(np.concatenate(c) for c in zip(*found))


_PAIRS: dict[tuple[str, str], Pair] = {}


class Texts:
    """Aligned texts of a slice: numbers and digest of each, and the distinct pairs of each with their times.

    A pair is a number: the id of A above the id of B, which takes the lower 32 bits.
    """

    def __init__(self, texts: list[str | None], own: Pair):
        self.n = len(texts)
        self.numbers = np.zeros((4, self.n), np.int64)
        self.digests = [""] * self.n
        self.pairs, self.times, self.cuts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        full = [k for k, t in enumerate(texts) if t]
        coded = [(k, x, y) for k, (x, y) in zip(full, own.encode([texts[k] for k in full])) if len(x)]
        if not coded:
            return
        owner, n_a, n_b = (np.array(c) for c in zip(*((k, len(x), len(y)) for k, x, y in coded)))
        a, b = np.concatenate([x for _, x, _ in coded]), np.concatenate([y for _, _, y in coded])
        # One text after another: the end of each is a common end.
        ends_a, ends_b = align(np.cumsum(own.bytes_a.sizes[a]), np.cumsum(own.bytes_b.sizes[b]))
        groups = np.searchsorted(ends_a, np.cumsum(n_a), "left") + 1
        sizes = np.diff(ends_a, prepend=0) * np.diff(ends_b, prepend=0)
        links = np.concatenate(([0], np.cumsum(sizes)))[groups]
        self.numbers[:, owner] = n_a, n_b, np.diff(groups, prepend=0), np.diff(links, prepend=0)
        self._digest(own, a, b, ends_a, ends_b, owner, n_a, n_b)
        at, first, second, times = linked(a, b, ends_a, ends_b)
        # Sorted by text and pair, as one number for both.
        every = own.n_a * own.n_b
        key = np.repeat(np.arange(len(owner)), n_a)[at] * every + first * own.n_b + second
        if (times > 1).any():
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
        else:
            key.sort()
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        a, b = np.divmod(key[new] % every, own.n_b)
        self.pairs, self.times = a << 32 | b, np.add.reduceat(times, new)
        self.cuts = np.searchsorted(owner[key[new] // every], np.arange(self.n + 1))

    def _digest(self, own: Pair, a, b, ends_a, ends_b, owner, n_a, n_b) -> None:
        """Digests of groups as text, a1,a2|b1;..., of each text."""
        starts_a, starts_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
        order = np.empty(len(a) + len(b), np.int64)
        x, y = a.copy(), b + 2 * own.n_a
        x[ends_a - 1] += own.n_a
        y[ends_b - 1] += own.n_b
        order[np.arange(len(a)) + np.repeat(starts_b, ends_a - starts_a)] = x
        order[np.arange(len(b)) + np.repeat(ends_a, ends_b - starts_b)] = y
        at = 0
        for k, n in zip(owner.tolist(), (n_a + n_b).tolist()):
            said = own.names.laid(order[at : at + n])
            self.digests[k] = hashlib.sha256(said[:-1].tobytes()).hexdigest()  # no semicolon after the last group
            at += n


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
#: A document's places in the dictionary of its block and their times, packed; or a pair of a block's dictionary.
BLOCKS = "__block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, __links binary, __pair long, __docs long"


def packed(places: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted places as steps, and times, as compressed bytes."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes() + times.astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
    return np.cumsum(numbers[: len(numbers) // 2]), numbers[len(numbers) // 2 :]


def _blocks(ranks: dict[bytes, int], pattern: str, pieces: str, schema: pa.Schema):
    """Aligns texts of Arrow batches of (key, text) in blocks: rows of documents, then of the block's dictionary."""

    def close(number: int, keys: list[pa.Array], done: list[Texts]) -> Iterator[pa.RecordBatch]:
        every, docs = np.unique(np.concatenate([t.pairs for t in done]), return_counts=True)
        kind = {f.name: f.type for f in schema}
        for key, t in zip(keys, done):
            places = np.searchsorted(every, t.pairs)
            links = [packed(places[i:j], t.times[i:j]) if j > i else None for i, j in zip(t.cuts, t.cuts[1:])]
            columns = {schema.names[0]: key, "__block": pa.array(np.full(len(key), number)), "groups_sha256": pa.array(t.digests, pa.string()), "__links": pa.array(links, pa.binary())}
            columns |= {n: pa.array(x) for n, x in zip(NUMBERS, t.numbers)}
            yield pa.record_batch([columns.get(n, pa.nulls(len(key), kind[n])) for n in schema.names], schema=schema)
        for at in range(0, len(every), 1 << 16):
            part = every[at : at + (1 << 16)]
            columns = {"__block": pa.array(np.full(len(part), number)), "__pair": pa.array(part), "__docs": pa.array(docs[at : at + (1 << 16)])}
            yield pa.record_batch([columns.get(n, pa.nulls(len(part), kind[n])) for n in schema.names], schema=schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (pattern, pieces) not in _PAIRS:
            _PAIRS[pattern, pieces] = Pair(ranks, pattern, pieces)
        own = _PAIRS[pattern, pieces]
        number, held, keys, done = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            sizes = np.cumsum(np.array([0, *(n or 0 for n in pc.binary_length(text).to_pylist())]))
            at = 0
            while at < len(text):
                end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + SLICE, "right")) - 1)
                done.append(Texts(text.slice(at, end - at).to_pylist(), own))
                keys.append(key.slice(at, end - at))
                held += int(sizes[end] - sizes[at])
                at = end
                if held >= BLOCK:
                    yield from close(number, keys, done)
                    number, held, keys, done = number + 1, 0, [], []
        if done:
            yield from close(number, keys, done)

    return blocks


def _summed(schema: pa.Schema, key: str):
    """Sums of the documents of a block, from its dictionary with counts."""

    def summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs.column("__pair").to_numpy())
        count = pairs.column("__count").to_numpy()[order]
        best = pairs.column("__best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        sums = np.zeros((2, docs.num_rows), np.int64)
        for i, links in enumerate(docs.column("__links").to_pylist()):
            if links is not None:
                places, times = unpacked(links)
                sums[:, i] = times @ best[places], times @ count[places]
        kept = [key, *NUMBERS, "groups_sha256"]
        columns = dict(zip(kept, (docs.column(n).combine_chunks() for n in kept))) | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
        return pa.table([columns[n] for n in schema.names], schema=schema)

    return summed


def align_tokenizers(df: DataFrame, byte_level: str, pattern: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each row of df.

    byte_level: a tokenizer file of byte-level BPE, the side A, and pattern: what splits its texts. pieces: a piece model
    with byte fallback, the side B.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = df.select(key).schema[0].dataType
    made = T.StructType([T.StructField("__key", kind), *T._parse_datatype_string(BLOCKS).fields])
    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    table = cut(rows.mapInArrow(_blocks(byte_level_ranks(byte_level), pattern, pieces, to_arrow_schema(made)), made))
    pairs = table.where("__pair is not null").select("__block", "__pair", "__docs")
    counts = pairs.groupBy("__pair").agg(F.sum("__docs").alias("__count"))
    first = F.shiftright("__pair", 32)
    best = counts.groupBy(first.alias("__a")).agg(F.max("__count").alias("__most"))
    told = pairs.join(counts, "__pair").withColumn("__a", first)
    told = told.join(F.broadcast(best), "__a")  # at most a row for each id of A's vocabulary
    told = told.select(F.col("__block").alias("__at"), "__pair", "__count", (F.col("__count") == F.col("__most")).alias("__best"))
    docs = table.where("__pair is null").select("__block", "__key", *NUMBERS, "groups_sha256", "__links")
    out = T.StructType([T.StructField("__key", kind), *(T.StructField(n, T.LongType()) for n in NUMBERS), T.StructField("groups_sha256", T.StringType()), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    summed = docs.groupBy("__block").cogroup(told.groupBy("__at")).applyInArrow(_summed(to_arrow_schema(out), "__key"), out)
    return summed.withColumnRenamed("__key", key)
