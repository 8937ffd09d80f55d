"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """True for rows of the held-out fold: crc32 of the id as text, modulo the number of folds."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that clash (in any letter case) with the ones an operator adds: the operator's own win."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def hash64(data: bytes) -> int:
    """A 64-bit hash that is equal on every machine."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session that df belongs to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def labelled_sample(documents: DataFrame, labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """Documents with a label of 0 or 1, about `most` rows: chosen by a hash of the key, alike on every run. A key with
    both labels has the label 1.

    The sampled labels have a bounded size, so they are broadcast and the documents stay where they are.
    """
    rows = labels.select(key, F.col(label).cast("int").alias(label)).where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias(label))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return documents.join(F.broadcast(rows), key)


class Memo(dict):
    """A dict that computes missing values. Holds `most` entries at most, in two halves: when the younger is full, it
    becomes the older, whose entries are forgotten with the next change but for those that were asked for.

    Long keys are computed anew each time, so that memory stays within most * (longest + value) bytes. met: a number of
    bits (a power of two) that tell which keys were asked for before; only these are held, as most keys come once.
    """

    def __init__(self, compute, most: int = 1 << 18, longest: int = 64, met: int = 0):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest
        self.older: dict = {}
        self.met = bytearray(met // 8)
        self.n_met = 0

    def _first(self, key) -> bool:
        """Whether a key is asked for the first time, as far as the bits tell; they are cleared when a quarter is set."""
        place = hash(key) & (8 * len(self.met) - 1)
        if self.met[place >> 3] >> (place & 7) & 1:
            return False
        self.n_met += 1
        if 4 * self.n_met > 8 * len(self.met):
            self.met, self.n_met = bytearray(len(self.met)), 0
        self.met[place >> 3] |= 1 << (place & 7)
        return True

    def __missing__(self, key):
        value = self.older.get(key, self)  # itself: no value
        if value is self:
            value = self.compute(key)
            if self.met and self._first(key):
                return value
        if len(key) <= self.longest:
            if 2 * len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value
