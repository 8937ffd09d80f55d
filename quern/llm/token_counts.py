"""Token counts by the whole-token shortcut.

A byte-fallback BPE vocabulary of pieces joins symbols by score. No piece has a word-start mark after another
character, so no merge crosses the start of a word: a text falls into pre-tokens that are encoded apart. Offline, on
the driver, each vocabulary string is merged once; those that end as one token form the whole-token set. A pre-token in
that set counts as one without any merging, and only the rest is merged.

Results for odd input: null and empty texts have 0 tokens; a text of blanks has the tokens of its marks; a very long
pre-token is merged with a heap in O(n log n) and is never cut.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, without

MARK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """What counting needs of a vocabulary. scores: of pieces that merges may make; whole: pieces that encode alone."""

    name: str
    scores: dict[str, float]
    whole: frozenset[str]
    splits_words: bool
    splits_lines: bool
    stops: str


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """Join neighbours by the highest score, leftmost first, until no join makes a piece."""
    return merge_long(text, scores) if len(text) > 64 else merge_short(text, scores)


def merge_short(text: str, scores: dict[str, float]) -> list[str]:
    """By scanning the scores of all neighbours: quadratic, but the quickest for words."""
    none = float("-inf")
    score = scores.get
    parts = list(text)
    joined = [score(a + b, none) for a, b in zip(parts, parts[1:])]
    while joined and (best := max(joined)) > none:
        i = joined.index(best)
        parts[i] += parts.pop(i + 1)
        del joined[i]
        if i < len(joined):
            joined[i] = score(parts[i] + parts[i + 1], none)
        if i:
            joined[i - 1] = score(parts[i - 1] + parts[i], none)
    return parts


def merge_long(text: str, scores: dict[str, float]) -> list[str]:
    """With a heap of the joins that are open."""
    symbols: list[str] = list(text)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(-scores[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in scores]
    heapq.heapify(heap)
    while heap:
        _, i, piece = heapq.heappop(heap)
        j = after[i]
        if not symbols[i] or j >= n or symbols[i] + symbols[j] != piece:
            continue
        symbols[i], symbols[j] = piece, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (p := piece + symbols[k]) in scores:
                heapq.heappush(heap, (-scores[p], i, p))
        if (h := before[i]) >= 0 and (p := symbols[h] + piece) in scores:
            heapq.heappush(heap, (-scores[p], h, p))
    return [s for s in symbols if s]


def load_vocabulary(model_file: str) -> Vocabulary:
    """Read a piece model and prove which of its strings encode alone as one token."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    scores = {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    }
    return Vocabulary(
        name=model_file,
        scores=scores,
        whole=frozenset(p for p in scores if len(merge(p, scores)) == 1),
        splits_words=not any(MARK in p.lstrip(MARK) for p in scores),
        splits_lines=not any("\n" in p and len(p) > 1 for p in scores),
        stops=stops_of(scores),
    )


def stops_of(scores: dict[str, float]) -> str:
    """Signs that no piece holds after another character than such signs or a mark.

    No merge joins it to what stands before, so a pre-token ends there.
    """
    pairs = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
    stops = {c for pair in pairs for c in pair if not c.isalpha() and c not in f"{MARK}\n"}
    while held := {b for a, b in pairs if b in stops and a not in stops and a != MARK}:
        stops -= held
    return "".join(sorted(stops))


def pieces_of(pre_token: str, vocabulary: Vocabulary) -> int:
    """Tokens of one pre-token: 1 by the shortcut, else by merging; a symbol outside the vocabulary costs its bytes."""
    if pre_token in vocabulary.whole:
        return 1
    scores = vocabulary.scores
    return sum(1 if s in scores else len(s.encode()) for s in merge(pre_token, scores))


def pre_token_pattern(vocabulary: Vocabulary) -> re.Pattern:
    """Cuts a marked text where no merge can cross."""
    if not vocabulary.splits_words:
        return re.compile(r"(?s).+")
    line = "\n" if vocabulary.splits_lines else ""
    stops = re.escape(vocabulary.stops)
    word = f"{MARK}*[^{MARK}{line}{stops}]+"
    if stops:
        word += f"|{MARK}*[{stops}]+[^{MARK}{line}{stops}]*"
    return re.compile(f"{word}|{MARK}+" + (f"|{line}" if line else ""))


_MEMOS: dict[str, Memo] = {}


def count_tokens(text: str | None, vocabulary: Vocabulary, memo: Memo | None = None) -> int:
    """Tokens of a whole text, without begin or end tokens."""
    if not text:
        return 0
    memo = memo if memo is not None else Memo(lambda p: pieces_of(p, vocabulary))
    return sum(map(memo.__getitem__, pre_token_pattern(vocabulary).findall(MARK + text.replace(" ", MARK))))


def token_count(text: Column, vocabulary: Vocabulary) -> Column:
    """Column of token counts."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _MEMOS.setdefault(vocabulary.name, Memo(lambda p: pieces_of(p, vocabulary), 1 << 19))
        for texts in batches:
            yield pd.Series([count_tokens(t, vocabulary, memo) for t in texts], dtype="int64")

    return counted(text)


def with_token_counts(df: DataFrame, vocabulary: Vocabulary, text: str = "text", limit: int = 4096) -> DataFrame:
    """df and its n_bytes, n_tokens and over_limit. Columns of df with these names are replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = without(df, "n_bytes", "n_tokens", "over_limit")
    return (
        kept.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": token_count(whole, vocabulary)})
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
