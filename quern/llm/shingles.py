"""Sets of word shingles as 64-bit hashes, taken from the buffers of Arrow columns without making Python strings.

Words are what stands between ASCII blanks, with A-Z made lower. A word's hash is a polynomial of its bytes, read off
prefix sums over a whole batch, and scrambled; a shingle's hash is built from the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once (or one word, if it is longer).
PIECE = 1 << 18
_RANDOM = np.random.Generator(np.random.PCG64(20_011)).integers(0, 1 << 63, 256, np.int64).view(np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: A random odd number for each byte; upper and lower case of A-Z have the same.
_VALUE = (_RANDOM * np.uint64(2) + np.uint64(1))[_LOWER]
_BLANK = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def scramble(h: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            grown = np.full(max(n, PIECE), base, np.uint64)
            grown[0] = 1
            _powers[i] = np.cumprod(grown, dtype=np.uint64)
    return _powers[0], _powers[1]


def _piece_words(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a piece of text; firsts: places where a text begins."""
    blank = _BLANK[data]
    begins = np.ones(len(data) + 1, bool)
    begins[1:-1] = blank[:-1]
    begins[firsts] = True
    starts = np.flatnonzero(begins[:-1] & ~blank)
    ends = np.flatnonzero(np.concatenate((blank[1:], [True])) & ~blank | begins[1:] & ~blank) + 1
    up, down = _powers_to(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    return starts, scramble((sums[ends] - sums[starts]) * down[starts])


def _piece_end(data: np.ndarray, firsts: np.ndarray, at: int) -> int:
    """Where a piece that begins at a place ends: before a blank or the start of a text, so that no word is cut."""
    end = at + PIECE
    while end < len(data):
        blanks = np.flatnonzero(_BLANK[data[at + 1 : end + 1]])
        first = np.searchsorted(firsts, end, "right") - 1
        last = max(at + 1 + int(blanks[-1]) if len(blanks) else 0, int(firsts[first]) if first >= 0 else 0)
        if last > at:
            return last
        end = at + 2 * (end - at)
    return len(data)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that stand one after another in data, and the number of words of each text."""
    starts, hashes, at, total = [], [], 0, len(data)
    firsts = offsets[:-1]
    firsts = firsts[firsts < total]
    while at < total:
        end = _piece_end(data, firsts, at)
        low, high = np.searchsorted(firsts, (at, end))
        s, h = _piece_words(data[at:end], firsts[low:high] - at)
        starts.append(s + at)
        hashes.append(h)
        at = end
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.diff(np.searchsorted(starts, offsets))


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one shingle."""
    words, counts = word_hashes(data, offsets)

    def joined(w: int, first: int, last: int) -> np.ndarray:
        """Shingles of w words that begin at words first to last."""
        out = words[first:last].copy()
        for i in range(1, w):
            out = scramble(out + _STEP) + words[first + i : last + i]
        return scramble(out + np.uint64(w))

    every = joined(width, 0, max(0, len(words) - width + 1))
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            found = np.sort(every[at : at + n - width + 1])
            if len(found) > 1:
                found = found[np.concatenate(([True], found[1:] != found[:-1]))]
        else:
            found = joined(n, at, at + 1) if n else every[:0]
        out.append(found)
        at += n
    return out


def column_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The set of each text of an Arrow column, a bounded number of texts at a time; null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield from sets_of(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], width)
        at = end


def shingles(text: str | None, width: int) -> np.ndarray:
    """The set of one text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return sets_of(data, np.array([0, len(data)]), width)[0]
