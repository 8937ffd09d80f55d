"""Ordered folds: a state for each key that its rows change one after another.

The rows of a key come to one task in order and pass through it as a stream, so a task holds one state and one batch,
however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame


def fold(df: DataFrame, key: str, order: list[str | Column], values: list[str], start: tuple, step: Callable[..., tuple], result: str) -> DataFrame:
    """(key, *result): the last state of each key. step(state, *values of a row) gives the next state.

    result: names and types of the state's parts. Keys must be longs; rows without key are left out.
    """
    rows = df.where(f"{key} IS NOT NULL").repartition(key).sortWithinPartitions(key, *order).select(key, *values)
    names = [key, *(part.split()[0] for part in result.split(","))]

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, start
        for batch in batches:
            done = []
            for own, *given in zip(batch[key].tolist(), *[batch[v].tolist() for v in values]):
                if own != now:
                    if now is not None:
                        done.append((now, *state))
                    now, state = own, start
                state = step(state, *given)
            if done:
                yield pd.DataFrame(done, columns=names)
        if now is not None:
            yield pd.DataFrame([(now, *state)], columns=names)

    return rows.mapInPandas(folded, f"{key} long, {result}")
