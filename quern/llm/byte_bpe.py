"""Byte-level BPE encoding and decoding with finite-state machines.

Encoding. A byte string has one valid tokenisation, and it is the one in which every two neighbouring tokens are what
the merges make of their joined bytes. So the last token of each prefix follows from the last tokens of shorter
prefixes. That makes a finite-state transducer over bytes. Its tokens are emitted as soon as every continuation agrees
on them; the lookahead is bounded by the longest vocabulary string. States are made only when they are met (lazy
determinisation) and forgotten when too many are held.

Decoding. Token bytes pass through an incremental UTF-8 state machine that holds back an unfinished character.

Results for odd input: null encodes as the empty text, which has no ids; ids of broken UTF-8 decode to U+FFFD as a
whole-text decoder would give it; very long texts and matches pass in one sweep.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, without


#: Bytes at the start of a match whose way through the transducer is kept.
HEAD = 4
#: Texts whose ids a task holds at once.
TEXTS = 256


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The merges themselves, lowest rank first, leftmost of equals: what the transducer is compiled from."""
    none = 1 << 40
    parts = [data[i : i + 1] for i in range(len(data))]
    joined = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while joined and (lowest := min(joined)) < none:
        i = joined.index(lowest)
        parts[i] += parts.pop(i + 1)
        del joined[i]
        if i < len(joined):
            joined[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            joined[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return parts


class Transducer:
    """Lazily determinised transducer from bytes to token ids.

    The vocabulary strings form a tree of prefixes. A place in the input is live while the bytes since then are a proper
    prefix of some vocabulary string. A state is the node of each live place, in order, with the last token before it; a
    move yields the state after one more byte and the length of the last token there. Tokens are emitted once all live
    places agree on them.
    """

    def __init__(self, ranks: dict[bytes, int], most_moves: int = 1 << 18, most_pairs: int = 1 << 19):
        self.ranks, self.most_moves = ranks, most_moves
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: By node: the node of each next byte, the token that ends here (or None), and how deep it lies.
        none: dict[int, int] = {}  # most nodes are leaves, and share this
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        self.depth = [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self.next[node] = self.next[node] or {}
                if byte not in below:
                    below[byte] = len(self.next)
                    self.next.append(none)
                    self.token.append(None)
                    self.depth.append(self.depth[node] + 1)
                node = below[byte]
            self.token[node] = rank
        self.apart: Memo = Memo(self._stay_apart, most_pairs, 2)
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone; what is known of pairs stays."""
        start = ((0, None),)
        self.numbers: dict[tuple, int] = {start: 0}
        self.states: list[tuple] = [start]
        self.moves: dict[int, tuple[int, int]] = {}
        #: What the first HEAD bytes lead to: many matches begin alike.
        self.heads: dict[bytes, tuple[int, tuple[int, ...]]] = {}

    def _stay_apart(self, pair: tuple[int, int]) -> bool:
        left, right = self.tokens[pair[0]], self.tokens[pair[1]]
        return merged(left + right, self.ranks) == [left, right]

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        live, last = [], -1
        for node, before in self.states[state]:  # the earliest place, and so the longest token, comes first
            below = self.next[node].get(byte)
            if below is None:
                continue
            if last < 0 and (token := self.token[below]) is not None and (before is None or self.apart[before, token]):
                last, length = token, self.depth[below]
            if self.next[below]:
                live.append((below, before))
        if last < 0:
            raise ValueError("no tokenisation: the vocabulary lacks a byte")
        live.append((0, last))
        new = tuple(live)
        number = self.numbers.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
        move = self.moves[state << 8 | byte] = (number, length)
        return move

    def _settled(self, state: int, lengths: list[int]) -> int:
        """How many of the bytes so far belong to tokens that no continuation can change."""
        ends = {len(lengths) - self.depth[node] for node, _ in self.states[state]}
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(last - lengths[last - 1])
        return ends.pop()

    def _emit(self, data: bytes, end: int, lengths: list[int]) -> list[int]:
        """Ids of the tokens of data[:end]."""
        ids = []
        while end:
            start = end - lengths[end - 1]
            ids.append(self.ranks[data[start:end]])
            end = start
        return ids[::-1]

    def _walk(self, data: bytes) -> tuple[int, tuple[int, ...]]:
        """The state after some bytes from the start, and the length of the last token after each."""
        state, lengths = 0, []
        for byte in data:
            state, length = self.moves.get(state << 8 | byte) or self._move(state, byte)
            lengths.append(length)
        return state, tuple(lengths)

    def encode(self, data: bytes, step: int = 4096) -> tuple[int, ...]:
        """Ids of one match of the splitting pattern."""
        if data in self.ranks:
            return (self.ranks[data],)
        if len(self.moves) > self.most_moves:
            self.forget()
        out: list[int] = []
        known, head = self.moves.get, data[:HEAD]
        if head not in self.heads:
            self.heads[head] = self._walk(head)
        state, begun = self.heads[head]
        lengths = list(begun)
        for at in range(len(begun), len(data), step):
            for byte in data[at : at + step]:
                state, length = known(state << 8 | byte) or self._move(state, byte)
                lengths.append(length)
            if at + step < len(data):
                end = at + step - len(lengths) + (done := self._settled(state, lengths))
                out += self._emit(data[end - done : end], done, lengths)
                del lengths[:done]
        return (*out, *self._emit(data[len(data) - len(lengths) :], len(lengths), lengths))


class Utf8Stream:
    """Turns pieces of UTF-8 into text, one after another; an unfinished character waits for its rest."""

    #: How many bytes a character has by its first byte: fixed by UTF-8.
    SIZES = ((0x80, 0x00, 1), (0xE0, 0xC0, 2), (0xF0, 0xE0, 3), (0xF8, 0xF0, 4))

    def __init__(self):
        self.held = b""

    def _open(self, data: bytes) -> int:
        """Bytes at the end that begin a character and may still grow into one."""
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = next((n for mask, bits, n in self.SIZES if byte & mask == bits), 1)
            if need <= back:
                return 0
            try:
                codecs.getincrementaldecoder("utf-8")("strict").decode(data[-back:])
            except UnicodeDecodeError:
                return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self._open(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], token_bytes: list[bytes], step: int = 4096) -> Iterator[str]:
    """Text of ids, step by step."""
    stream, ids = Utf8Stream(), list(ids)
    for i in range(0, len(ids), step):
        yield stream.feed(b"".join(map(token_bytes.__getitem__, ids[i : i + step])))
    yield stream.finish()


#: Texts without such characters are split by a pattern of plain character classes, which is several times faster.
BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def latin_pattern(pattern: str):
    """findall of an equal pattern for texts up to U+024F: its Unicode classes written out; None if it has others."""
    import regex

    chars = [chr(i) for i in range(0x250)]

    def written(kind: str) -> str:
        return "[" + "".join(re.escape(c) for c in chars if regex.fullmatch(kind, c)) + "]"

    for kind in (r"[^\s\p{L}\p{N}]", r"\p{L}", r"\p{N}", r"\S", r"\s"):
        pattern = pattern.replace(kind, written(kind))
    return None if r"\p" in pattern else re.compile(pattern).findall


class Codec:
    """Splits, encodes and decodes whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.any_find = regex.compile(pattern).findall
        self.latin_find = latin_pattern(pattern)
        self.transducer = Transducer(ranks)
        self.memo = Memo(lambda match: self.transducer.encode(match.encode()), 1 << 18, met=1 << 23)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.names = [str(i) for i in range(len(self.bytes))]

    def find(self, text: str) -> list[str]:
        """Matches of the splitting pattern; together they make up the text."""
        if self.latin_find and not BEYOND_LATIN.search(text):
            return self.latin_find(text)
        return self.any_find(text)

    def rest(self) -> None:
        """Give back the memory that is soon filled again; called when a task ends, as the worker may do other work then."""
        self.memo.older = {}
        self.transducer.forget()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.find(text))))

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(decode_stream(ids, self.bytes))


_CODECS: dict[str, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of this Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(load_ranks(path), pattern)
    return _CODECS[path]


def _slices(batches: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    """The texts of Arrow arrays, few at a time, so that the ids of few texts are held at once."""
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            yield batch.slice(at, TEXTS).to_pylist()


def _lists(ids: list[list[int]]) -> pa.Array:
    """Lists of ids as one Arrow array."""
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))))


def _ids(ranks_path: str, pattern: str):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(ranks_path, pattern)
        for texts in _slices(batches):
            yield _lists([own.encode(t or "") for t in texts])
        own.rest()

    return encoded


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with an array of token ids; a column of that name is replaced."""
    return without(df.withColumn("__ids", _ids(ranks_path, pattern)(F.col(text))), ids).withColumnRenamed("__ids", ids)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of its token ids; null ids give an empty text."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(ranks_path, pattern)
        for rows in batches:
            yield pd.Series([own.decode(r if r is not None else ()) for r in rows])

    return without(df.withColumn("__text", decoded(F.col(ids))), text).withColumnRenamed("__text", text)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """df with n_tokens and digests of the ids and of the decoded bytes, encoded and decoded in one pass.

    ids: a column for the ids themselves; None leaves them out. Columns of df with these names are replaced.
    """
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    @F.arrow_udf(kind)
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(ranks_path, pattern)
        for texts in _slices(batches):
            every, said, decoded = [], [], []
            for t in texts:
                found = own.encode(t or "")
                back = hashlib.sha256()
                for part in decode_stream(found, own.bytes):
                    back.update(part.encode())
                said.append(hashlib.sha256(" ".join(map(own.names.__getitem__, found)).encode()).hexdigest())
                decoded.append(back.hexdigest())
                every.append(found)
            columns = {"n_tokens": pa.array(map(len, every), pa.int64()), "ids_sha256": pa.array(said, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            columns |= {"ids": _lists(every)} if ids else {}
            yield pa.StructArray.from_arrays([*columns.values()], [*columns])
        own.rest()

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    out = without(df.withColumn("__coded", coded(F.col(text))), *names, *([ids] if ids else []))
    told = [F.col(f"__coded.{n}") for n in names] + ([F.col("__coded.ids").alias(ids)] if ids else [])
    return out.select("*", *told).drop("__coded")
