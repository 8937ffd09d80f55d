"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point alone. A trigram is bound by multiplying its
letters' vectors, each permuted (rolled) by its place; a text bundles the vectors of its trigrams. Word ends count as
one more letter. A language's prototype bundles its learning texts, each weighted alike; a text goes to the prototype
of the largest cosine.

Results for odd input: a text that is null or has no letter is `und` with score 0, and so is every text when nothing
was learned. Ties go to the language that sorts first. Very long texts are bundled in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

DIMS = 512
SEED = 20_011
UNKNOWN = "und"
#: Code points of a batch, and of a piece of a long text.
PIECE, BATCH = 200_000, 600_000
#: Partial bundles are summed as integers of this resolution, so that their order doesn't matter.
UNIT = 1_000_000


class Profiles:
    """Bundles texts; keeps the vectors of trigrams that it has met, up to `most` of them."""

    def __init__(self, dims: int = DIMS, seed: int = SEED, most: int = 1 << 16):
        self.dims, self.seed, self.most = dims, seed, most
        self.letter_vectors: dict[int, np.ndarray] = {}
        self.is_letter = np.zeros(0x110000, bool)
        self.seen = np.zeros(0x110000, bool)
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((1024, dims), np.int8)

    def _letters(self, text: str) -> np.ndarray:
        """Code points of the letters, in lower case; each stretch of other signs is one 0, and so are both ends."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for point in np.unique(points[~self.seen[points]]):
            self.seen[point] = True
            self.is_letter[point] = chr(point).isalpha()
        letters = np.where(self.is_letter[points], points, 0)
        letters = np.concatenate(([0], letters, [0])).astype(np.int64)
        return letters[(letters != 0) | np.concatenate(([True], letters[:-1] != 0))]

    def _letter_vector(self, point: int) -> np.ndarray:
        if point not in self.letter_vectors:
            if len(self.letter_vectors) >= self.most:
                self.letter_vectors.clear()
            random = np.random.Generator(np.random.PCG64([self.seed, point]))
            self.letter_vectors[point] = (random.integers(0, 2, self.dims, np.int8) * 2 - 1).astype(np.int8)
        return self.letter_vectors[point]

    def _trigram_vectors(self, trigrams: np.ndarray) -> np.ndarray:
        """Vectors of distinct trigrams, which are given as three code points of 21 bits."""
        if len(self.rows) + len(trigrams) > self.most:
            self.rows.clear()
        at = np.empty(len(trigrams), np.int64)
        for i, trigram in enumerate(trigrams.tolist()):
            row = self.rows.get(trigram)
            if row is None:
                row = self.rows[trigram] = len(self.rows)
                if row >= len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                a, b, c = (self._letter_vector((trigram >> shift) & 0x1FFFFF) for shift in (42, 21, 0))
                self.vectors[row] = np.roll(a, 2) * np.roll(b, 1) * c
            at[i] = row
        return self.vectors[at].astype(np.float32)

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """One vector for each text; a text without letters has zeros."""
        return self._bundled(texts, range(len(texts)), len(texts), False)

    def bundle_groups(self, texts: list[str | None], groups: list[int], n: int) -> np.ndarray:
        """One vector for each of n groups of texts; every text has the same weight."""
        return self._bundled(texts, groups, n, True)

    def _bundled(self, texts, owners, n: int, even: bool) -> np.ndarray:
        out = np.zeros((n, self.dims), np.float32)
        held: list[tuple[int, np.ndarray, float]] = []
        size = 0
        for i, text in zip(owners, texts):
            for at in range(0, len(text or ""), PIECE):
                letters = self._letters(text[max(0, at - 2) : at + PIECE])
                if len(letters) >= 3:
                    held.append((i, letters, 1 / len(text) if even else 1))
                    size += len(letters)
                if size >= BATCH:
                    self._add(out, held)
                    held, size = [], 0
        self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple[int, np.ndarray, float]]) -> None:
        if not held:
            return
        held.sort(key=lambda x: x[0])
        points = np.concatenate([x for _, x, _ in held])
        lengths = [len(x) for _, x, _ in held]
        owners, row = np.unique([i for i, _, _ in held], return_inverse=True)
        owner = np.repeat(row.astype(np.int32), lengths)
        weight = np.repeat([w for _, _, w in held], lengths)
        edge = np.ones(len(points), bool)
        edge[np.cumsum(lengths) - 1] = edge[np.cumsum(lengths) - 2] = False
        present = np.flatnonzero(np.bincount(points))
        k = len(present)
        number = np.zeros(present[-1] + 1, np.int64)
        number[present] = np.arange(k)
        small = number[points]
        keys = (small[:-2] * k + small[1:-1]) * k + small[2:]
        within = edge[:-2] & (points[1:-1] != 0)
        keys, owner, weight = keys[within], owner[:-2][within], weight[:-2][within]
        if k**3 <= 1 << 22:
            found = np.flatnonzero(np.bincount(keys, minlength=1))
            dense = np.zeros(k**3, np.int64)
            dense[found] = np.arange(len(found))
            keys = dense[keys]
        else:
            found, keys = np.unique(keys, return_inverse=True)
        if not len(found):
            return
        trigrams = (present[found // (k * k)] << 42) | (present[found // k % k] << 21) | present[found % k]
        vectors = self._trigram_vectors(trigrams)
        step = max(1, (1 << 22) // len(found))
        for at in range(0, len(owners), step):
            low, high = np.searchsorted(owner, (at, at + step))
            n = min(step, len(owners) - at)
            cells = (owner[low:high] - at) * len(found) + keys[low:high]
            counts = np.bincount(cells, weight[low:high], n * len(found)).reshape(n, len(found))
            out[owners[at : at + step]] += counts.astype(np.float32) @ vectors


_PROFILES: dict[tuple[int, int], Profiles] = {}


def profiles(dims: int, seed: int) -> Profiles:
    """The profiles of this Python worker."""
    return _PROFILES.setdefault((dims, seed), Profiles(dims, seed))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", dims: int = DIMS, seed: int = SEED) -> dict[str, list[float]]:
    """Prototypes of all languages in df, over all its rows; rows without text or language teach nothing.

    Each task adds up its own bundles, one for each language; only those sums are shuffled.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, groups = np.unique(batch["l"].to_numpy(str), return_inverse=True)
            bundles = profiles(dims, seed).bundle_groups(batch["t"].tolist(), groups.tolist(), len(names))
            for name, vector in zip(names.tolist(), bundles):
                sums[name] = sums.get(name, 0) + np.rint(vector.astype(np.float64) * UNIT).astype(np.int64)
        for name, total in sums.items():
            yield pd.DataFrame({"l": name, "d": np.arange(dims), "v": total})

    taught = df.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    sums = taught.mapInPandas(partial, "l string, d int, v long").groupBy("l", "d").agg(F.sum("v").alias("v"))
    vectors: dict[str, np.ndarray] = {}
    for row in sums.collect():  # languages x dims: no more with more documents
        vectors.setdefault(row.l, np.zeros(dims))[row.d] = row.v
    found = {name: v / size for name, v in sorted(vectors.items()) if (size := np.sqrt(v @ v))}
    return {name: v.tolist() for name, v in found.items()}


def predict(text: Column, prototypes: dict[str, list[float]], dims: int = DIMS, seed: int = SEED) -> Column:
    """Column of structs: lang_pred, and the cosine with its prototype as score, 0 at least."""
    names = list(prototypes)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matrix = np.array([prototypes[n] for n in names], np.float64).reshape(len(names), dims).T
        for texts in batches:
            bundles = profiles(dims, seed).bundle(texts.tolist()).astype(np.float64)
            size = np.sqrt((bundles**2).sum(axis=1))
            known = (size > 0) & bool(names)
            cosines = bundles @ matrix / np.maximum(size, 1e-9)[:, None] if names else np.zeros((len(texts), 1))
            best = cosines.argmax(axis=1)
            yield pd.DataFrame(
                {
                    "lang_pred": np.where(known, np.array(names or [UNKNOWN], object)[best], UNKNOWN),
                    "score": np.where(known, np.clip(cosines.max(axis=1), 0, 1), 0.0),
                }
            )

    return predicted(text)


def identify(df: DataFrame, prototypes: dict[str, list[float]], text: str = "text", dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """df with lang_pred and score; columns of df with these names are replaced."""
    out = df.withColumn("__lang", predict(F.col(text), prototypes, dims, seed))
    return without(out, "lang_pred", "score").select("*", "__lang.*").drop("__lang")
