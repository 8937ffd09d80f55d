"""Toxicity of texts whose words may be disguised, by a noisy channel.

Words with look-alike signs, drawn-out letters or spaced-out letters are lattices: each sign may stand for itself or
for some letters, a run of one letter for one or two of them, a separator for nothing. A Viterbi search through the
lattice finds the letters that a character trigram model of the whole corpus holds likeliest. Words as written and as
restored are then scored by log odds that are learned from labelled texts.

Results for odd input: null and empty texts get the prior of the label; without any label the prior is 0.01; repeated
words count once; texts and words of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, hash64, labelled_sample, without
from .components import cut

#: Letters that signs stand for in disguised words. Fixed values.
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c",
}
SEPARATORS = ".-_*~' "
#: Costs of the channel, in nats: a sign read as a letter, one read as itself, and a doubled letter read as one.
READ_AS, READ_SAME, READ_ONCE = 0.7, 6.0, 0.7
#: What stands around a word, and what stands for all letters without case, so that trigrams are those of alphabets.
EDGE, OTHER = "\0", "\1"
#: Letters of a spaced-out word: shorter ones aren't told from chance; longer ones are looked for if longer words are learned.
SPELLED = (3, 12)
#: Labelled rows that word weights are learned from, about; chosen by a hash of the id, the same on every run.
LABELLED = 20_000
#: A word or stem is evidence if it is so much likelier in labelled texts, beyond chance by this G statistic.
LEAST_RATIO, LEAST_G = 8.0, 24.0
STEMS = (4, 5)
NO_LABELS = 0.01

SIGNS = "".join(re.escape(c) for c in LOOKS)
SUSPECT = re.compile(
    rf"[^\W\d_][{SIGNS}]+[^\W\d_]|[{SIGNS}][^\W\d_]{{2}}|[^\W\d_]{{2}}[{SIGNS}]$|([^\W\d_])\1|[^\W\d_][.\-_*~][^\W\d_]"
    rf"|^(?:[\w{SIGNS}][{re.escape(SEPARATORS)}]+){{2,}}[\w{SIGNS}]$"
)
#: Signs with separators between them, as in i-d or i.d.i.
SPELT = re.compile(rf"(?:[^\W_]|[{SIGNS}])(?:[{re.escape(SEPARATORS.strip())}]+(?:[^\W_]|[{SIGNS}]))+")
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "…«»“”‘’¡¿"


@dataclass
class CharacterModel:
    """Interpolated trigram model of letters; EDGE stands before and after a word."""

    trigrams: dict[str, int]
    bigrams: dict[str, int] = field(default_factory=dict)
    singles: dict[str, int] = field(default_factory=dict)
    total: int = 0

    def __post_init__(self):
        for trigram, n in self.trigrams.items():
            self.bigrams[trigram[:2]] = self.bigrams.get(trigram[:2], 0) + n
            self.singles[trigram[2]] = self.singles.get(trigram[2], 0) + n
            self.total += n

    def cost(self, before: str, letter: str) -> float:
        """Minus the log probability of a letter after two others."""
        three = self.trigrams.get(before + letter, 0) / (self.bigrams.get(before, 0) or 1)
        one = (self.singles.get(letter, 0) + 0.1) / (self.total + 100)
        return -math.log(0.9 * three + 0.1 * one)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each stretch of equal signs of a word: what it may be read as, and at what cost."""
    return list(lattice_steps(word))


def lattice_steps(word: str) -> Iterator[list[tuple[str, float]]]:
    for m in re.finditer(r"(?s)(.)\1*", word):
        sign, n = m[1], m.end() - m.start()
        if sign in LOOKS:
            reads = [(c * k, READ_AS * k) for c in LOOKS[sign] for k in {1, min(n, 2)}] + [(sign * n, READ_SAME * n)]
        elif sign in SEPARATORS:
            reads = [("", 0.0)]
        elif n >= 3:
            reads = [(sign, 0.0), (sign * 2, 0.0)]
        elif n == 2 and sign.isalpha():
            reads = [(sign, READ_ONCE), (sign * 2, 0.0)]
        else:
            reads = [(sign * n, 0.0)]
        yield reads


class Reach:
    """Whether any path through a word's lattice can give one of some words, or begin with one of some stems.

    Where none can, the likeliest path gives none of these features either, and the search for it is left out."""

    def __init__(self, features: Iterable[str]):
        self.stems = frozenset(f[:-1] for f in features if f.endswith("-"))
        self.words = frozenset(f for f in features if not f.endswith("-"))
        self.begun = frozenset(f[:k] for f in self.words | self.stems for k in range(len(f) + 1))

    def __call__(self, word: str) -> bool:
        if word[:1].isalpha() and word[:1] not in self.begun:
            return False
        states = {""}
        for reads in lattice_steps(word):
            after = set()
            for state in states:
                for read, _ in reads:
                    now = state
                    for letter in read:
                        now += letter
                        if now in self.stems:
                            return True
                        if now not in self.begun:
                            break
                    else:
                        after.add(now)
            states = after
            if not states:
                return False
        return not states.isdisjoint(self.words)


def restore(word: str, model: CharacterModel) -> str:
    """The likeliest letters of a disguised word: Viterbi over states of the last two letters."""
    best: dict[str, tuple[float, tuple | None]] = {EDGE * 2: (0.0, None)}
    for reads in lattice(word):
        after: dict[str, tuple[float, tuple | None]] = {}
        for state, (cost, path) in best.items():
            for read, own in reads:
                now, at = cost + own, state
                for letter in read:
                    now += model.cost(at, letter)
                    at = at[1] + letter
                if at not in after or now < after[at][0]:
                    after[at] = (now, (path, read) if read else path)
        best = after
    _, path = min((cost + model.cost(state, EDGE), path or ()) for state, (cost, path) in best.items())
    out = []
    while path:
        path, read = path
        out.append(read)
    return "".join(reversed(out))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def readings(word: str, model: CharacterModel, reach: Reach | None = None) -> set[str]:
    """A word without the signs around it, as written and, if it looks disguised (and may reach a feature), as restored."""
    plain = word.strip(EDGES)
    found = {plain} if plain else set()
    whole = word.strip("\"'.,:;?")
    for form in {plain, whole.rstrip("!|")}:
        if form and (reach is None or reach(form)) and SUSPECT.search(form):
            found.add(restore(form, model))
    return found


def features_of(readings_: set[str]) -> set[str]:
    """A word's features: itself, and its stems, which are marked by a hyphen."""
    return readings_ | {f"{w[:k]}-" for w in readings_ for k in STEMS if len(w) > k}


def signs_of(word: str) -> str:
    """The signs of a word that is one sign or signs with separators between them, without quotes and the like around it."""
    if len(word) == 1:
        return word
    plain = word.strip(EDGES)
    if len(plain) == 1:
        return plain
    return "".join(c for c in plain if c not in SEPARATORS) if SPELT.fullmatch(plain) else ""


def spaced(words: list[str], signs: dict[str, str], most: int) -> set[str]:
    """Parts of stretches of single signs, joined by blanks; signs: those of each distinct word that has any.

    A stretch may hold other single letters before and after a spelled word, so each of its parts of up to `most` signs
    may be one.
    """
    out: set[str] = set()
    held: list[str] = []
    least = SPELLED[0]
    for w in [*words, ""]:
        if w in signs:
            held.extend(signs[w])
        elif held:
            for at in range(len(held) - least + 1):
                for end in range(at + least, min(len(held), at + most) + 1):
                    if len(set(held[at:end])) > 1:
                        out.add(" ".join(held[at:end]))
            held = []
    return out


def text_words(text: str, most: int = SPELLED[1]) -> set[str]:
    """Distinct words, and what may be spelled by spaced letters."""
    words = words_of(text)
    distinct = set(words)
    signs = {w: found for w in distinct if (len(w) == 1 or not w.isalnum()) and (found := signs_of(w))}
    if sum(map(len, signs.values())) > 1:
        distinct |= spaced(words, signs, most)
    return distinct


def longest(weights: dict[str, float]) -> int:
    """Signs of the longest spaced-out word that can tell: a longer one is none of the words, and its first letters tell."""
    return max([SPELLED[1], *(len(f) for f in weights if not f.endswith("-"))])


def evidence(text: str, memo: Memo, most: int = SPELLED[1]) -> tuple[float, float, float]:
    """Of the telling words of a text: the largest log odds, the second largest, and the log of their number.

    memo: gives the telling reading of a word and its log odds, or None. most: signs of a spaced-out word.
    """
    found = dict(filter(None, map(memo.__getitem__, text_words(text, most))))
    if not found:
        return 0.0, 0.0, 0.0
    odds = sorted(found.values(), reverse=True)
    return odds[0], odds[1] if len(odds) > 1 else 0.0, math.log1p(len(odds))


def telling(model: CharacterModel, weights: dict[str, float]):
    """The function of a word that evidence() needs."""
    reach = Reach(weights)

    def told(word: str) -> tuple[str, float] | None:
        plain = word.strip(".,")
        if plain.isalpha() and plain not in weights and not any(plain[:k] + "-" in weights for k in STEMS) and not reach(plain):
            return None
        found = [(weights[f], f) for f in features_of(readings(word, model, reach)) if f in weights]
        if not found:
            return None
        odds, feature = max(found)
        return feature.rstrip("-"), odds

    return told


def learn_characters(df: DataFrame, text: str = "text") -> CharacterModel:
    """Trigram counts of the words of all rows. Each task counts its own; the sums are those of trigrams of letters that
    have case, which are bounded by the alphabets, whatever the number of rows."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = TrigramCounts()
        for batch in batches:
            for t in batch["t"]:
                counts.add(t)
        a, b, c, n = counts.totals()
        yield pd.DataFrame({"a": a, "b": b, "c": c, "n": n})

    texts = df.select(F.col(text).alias("t")).where("t is not null")
    sums = texts.mapInPandas(counted, "a int, b int, c int, n long").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))
    return CharacterModel({chr(r.a) + chr(r.b) + chr(r.c): r.n for r in sums.collect()})


class TrigramCounts:
    """Counts letter trigrams of lower-cased texts, with EDGE for every stretch of other signs."""

    def __init__(self, letters: int = 96, piece: int = 1 << 20):
        self.piece, self.letters = piece, letters
        self.small = np.full(0x110000, -1, np.int32)  # -1: not met yet
        self.points = [ord(EDGE), ord(OTHER)]
        self.dense = np.zeros(letters**3, np.int64)
        self.rest: dict[tuple[int, int, int], int] = {}
        self.held: list[str] = []
        self.size = 0

    def add(self, text: str) -> None:
        """Texts are gathered until they fill a piece; a long one is cut into pieces."""
        for at in range(0, len(text), self.piece):
            self.held.append(text[at : at + self.piece])
            self.size += len(self.held[-1])
            if self.size >= self.piece:
                self._count()

    def _count(self) -> None:
        joined, self.held, self.size = "\n".join(self.held), [], 0
        points = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.small[points]
        if len(found) and found.min() < 0:
            for point in np.unique(points[found < 0]).tolist():
                letter = chr(point)
                cased = letter.isalpha() and letter.upper() != letter
                self.small[point] = len(self.points) if cased else int(letter.isalpha())
                self.points += [point] * cased
            found = self.small[points]
        found = np.concatenate(([0, 0], found, [0])).astype(np.int64)
        a, b, c = found[:-2], found[1:-1], found[2:]
        a = np.where(b == 0, 0, a)  # at the start of a word both places before it are edges
        kept = (b != 0) | (c != 0)
        k = self.letters
        common = kept if len(self.points) <= k else kept & (a < k) & (b < k) & (c < k)
        self.dense += np.bincount(((a * k + b) * k + c)[common], minlength=k**3)
        if common is not kept:
            rest = kept & ~common
            for key in zip(a[rest].tolist(), b[rest].tolist(), c[rest].tolist()):
                self.rest[key] = self.rest.get(key, 0) + 1

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of the three letters, and counts."""
        self._count()
        k = self.letters
        keys = np.flatnonzero(self.dense)
        points = np.array(self.points)
        rest = np.array(list(self.rest), np.int64).reshape(-1, 3)
        three = np.concatenate((np.stack((keys // (k * k), keys // k % k, keys % k), 1), rest))
        n = np.concatenate((self.dense[keys], np.array(list(self.rest.values()), np.int64)))
        return (*(points[three[:, i]] for i in range(3)), n)


@dataclass(frozen=True)
class Scorer:
    """What scoring needs: the letters' model, log odds of words and stems, and how evidence adds up (bias first)."""

    model: CharacterModel
    weights: dict[str, float]
    sums: tuple[float, float, float, float]


def copies_key(text: str) -> int:
    """The least hash of three words in a row: near copies of a text mostly have the same."""
    words = words_of(text)
    return min((hash64(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0) >> 1


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model with a bias in front, by Newton steps."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def learn_words(
    documents: DataFrame, labels: DataFrame, model: CharacterModel, key: str = "doc_id", text: str = "text", label: str = "toxic",
    most: int = LABELLED,
) -> Scorer:
    """Log odds of words and stems from up to about `most` labelled rows, one of each set of near copies.

    Copies would make every word of a copied text look telling. How evidence adds up is fitted on a third of the rows,
    which the log odds are not learned from. Counts of a task are added up before the shuffle.
    """
    rows = labelled_sample(documents.select(key, F.col(text).alias("t")).where("t is not null"), labels, key, label, most)

    @F.pandas_udf("long")
    def keyed(texts: pd.Series) -> pd.Series:
        return texts.map(copies_key).astype("int64")

    def counted(kept: frozenset[str] | None):
        """Counts features, or those among `kept`, in the rows of a task."""

        def rows_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            nothing: frozenset[str] = frozenset()
            reach = None if kept is None else Reach(kept)
            memo = Memo(lambda w: frozenset(f for f in features_of(readings(w, model, reach)) if kept is None or f in kept) or nothing, 1 << 17)
            counts: dict[str, list[int]] = {"": [0, 0]}
            for batch in batches:
                for t, y in zip(batch["t"], batch["y"]):
                    counts[""][y] += 1
                    for f in set().union(*map(memo.__getitem__, text_words(t))):
                        counts.setdefault(f, [0, 0])[y] += 1
            yield pd.DataFrame([(f, *x) for f, x in counts.items()], columns=["f", "n0", "n1"])

        return rows_

    def summed(rows: DataFrame, kept: frozenset[str] | None) -> DataFrame:
        sums = rows.select("t", "y").mapInPandas(counted(kept), "f string, n0 long, n1 long")
        return sums.groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    rows = rows.select("t", F.col(label).alias("y")).withColumn("k", keyed("t"))
    single = cut(rows.groupBy("k", "y").agg(F.min("t").alias("t")).withColumn("third", F.pmod(F.xxhash64("k"), F.lit(3))))
    # First the features of rows with the label, which are few; then these in all rows. The sample is bounded, so both are.
    often = summed(single.where("third > 0 and y = 1"), None).where("f != '' and n1 >= 4").select("f").collect()
    sums = summed(single.where("third > 0"), frozenset(r.f for r in often)).collect()
    all0, all1 = next(((r.n0, r.n1) for r in sums if not r.f), (0, 0))
    prior = (all1 + NO_LABELS) / (all0 + all1 + 1)
    weights = {}
    for r in sums if all0 and all1 else []:
        ratio = (r.n1 + 0.5) / (all1 + 1) / ((r.n0 + 0.5) / (all0 + 1))
        g = 2 * r.n1 * math.log(r.n1 * (all0 + all1) / ((r.n0 + r.n1) * all1)) if r.n1 else 0
        if r.f and ratio >= LEAST_RATIO and g >= LEAST_G:
            weights[r.f] = math.log(ratio)
    if not weights:
        return Scorer(model, {}, (math.log(prior / (1 - prior)), 0.0, 0.0, 0.0))

    @F.pandas_udf("a double, b double, c double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo, most = Memo(telling(model, weights), 1 << 17), longest(weights)
        for texts in batches:
            yield pd.DataFrame([evidence(t, memo, most) for t in texts], columns=["a", "b", "c"])

    rest = single.where("third = 0").select("y", told("t").alias("x")).select("y", "x.*").toPandas()
    rest = rest.sort_values(list(rest.columns), kind="stable")
    sums = logistic(rest[["a", "b", "c"]].to_numpy(), rest["y"].to_numpy()) if len(rest) else [math.log(prior / (1 - prior)), 1, 1, 0]
    return Scorer(model, weights, tuple(round(float(w), 6) for w in sums))


def score(text: Column, scorer: Scorer) -> Column:
    """Column of probabilities of the label."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo, most = Memo(telling(scorer.model, scorer.weights), 1 << 18), longest(scorer.weights)
        for texts in batches:
            out = []
            for t in texts:
                logit = sum(w * x for w, x in zip(scorer.sums, (1.0, *evidence(t or "", memo, most))))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
            yield pd.Series(out, dtype="float64")

    return scored(text)


def with_toxicity(df: DataFrame, scorer: Scorer, text: str = "text", least: float = 0.5) -> DataFrame:
    """df with score and predicted (1 from `least` on); columns of df with these names are replaced."""
    out = without(df.withColumn("__score", score(F.col(text), scorer)), "score", "predicted")
    return out.withColumnRenamed("__score", "score").withColumn("predicted", (F.col("score") >= least).cast("int"))
