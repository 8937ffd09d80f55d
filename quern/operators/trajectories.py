"""Assertions about the order of a key's events: never, at most, at least, before, followed within, only, no cycle.

Every assertion is an automaton whose summaries of two neighbouring stretches of rows join into the summary of both.
So the rows are dealt by ranges of (key, time, id), not by key: a key with a third of all rows spreads over a third of
the tasks. Each task reads its rows once, in order, for all assertions, and sends one small summary for each key it
meets; the summaries of a key, at most one a task, are then joined in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def earliest(*times: int | None) -> int | None:
    return min((t for t in times if t is not None), default=None)


@dataclass(frozen=True)
class AtMost:
    """`event` comes n times at most (0: never). It fails at the first event too many. Summary: the first n + 1 times."""

    event: str
    n: int = 0

    def one(self, t: int, event: str) -> list | None:
        return [t] if event == self.event else None

    def join(self, a: list, b: list) -> list:
        return (a + b)[: self.n + 1]

    def verdict(self, a: list | None) -> tuple[bool, int | None]:
        return (False, a[self.n]) if a and len(a) > self.n else (True, None)


@dataclass(frozen=True)
class AtLeast:
    """`event` comes n times at least. A failure has no time. Summary: the count, n at most."""

    event: str
    n: int = 1

    def one(self, t: int, event: str) -> int | None:
        return 1 if event == self.event else None

    def join(self, a: int, b: int) -> int:
        return min(a + b, self.n)

    def verdict(self, a: int | None) -> tuple[bool, int | None]:
        return (a or 0) >= self.n, None


@dataclass(frozen=True)
class Only:
    """No other events than these. It fails at the first other one, whose time is the summary."""

    events: tuple[str, ...]

    def one(self, t: int, event: str) -> int | None:
        return None if event in self.events else t

    def join(self, a: int, b: int) -> int:
        return a

    def verdict(self, a: int | None) -> tuple[bool, int | None]:
        return a is None, a


@dataclass(frozen=True)
class Before:
    """`event` comes only after a `first`. It fails at the first `event` without one before it.

    Summary: is there a `first`, and the time of the first `event` that has none before it in the stretch."""

    first: str
    event: str

    def one(self, t: int, event: str) -> list | None:
        if event == self.event:
            return [event == self.first, t]
        return [True, None] if event == self.first else None

    def join(self, a: list, b: list) -> list:
        return a if a[0] else [b[0], earliest(a[1], b[1])]

    def verdict(self, a: list | None) -> tuple[bool, int | None]:
        return (True, None) if a is None or a[1] is None else (False, a[1])


@dataclass(frozen=True)
class Followed:
    """Each `event` has a later `by` not more than `within` after it. It fails at the first `event` that has none.

    Of several events that wait for the same `by`, the first waits longest: if it is answered in time, all are.
    Summary: the first `by`; the first event after the last `by`; the first event known to fail."""

    event: str
    by: str
    within: int

    def one(self, t: int, event: str) -> list | None:
        found = [t if event == self.by else None, t if event == self.event else None, None]
        return found if event in (self.by, self.event) else None

    def join(self, a: list, b: list) -> list:
        (by, waits, bad), (next_by, next_waits, next_bad) = a, b
        answered = next_by is not None
        late = waits if waits is not None and answered and next_by - waits > self.within else None
        return [next_by if by is None else by, next_waits if answered or waits is None else waits, earliest(bad, late, next_bad)]

    def verdict(self, a: list | None) -> tuple[bool, int | None]:
        bad = earliest(a[1], a[2]) if a else None
        return bad is None, bad


@dataclass(frozen=True)
class NoCycle:
    """No `length` distinct events in a row that come `times` times one after another (length 1: no event repeated at once).

    It fails at the event that ends the first such cycle. Summary: the first and last rows of the stretch, one less than
    a cycle has, and the first end of a cycle in it: a cycle over the border of two stretches lies in the last rows of one
    and the first of the other."""

    length: int
    times: int

    def one(self, t: int, event: str) -> list:
        return [[[t, event]], [[t, event]], None]

    def join(self, a: list, b: list) -> list:
        (head, tail, bad), (next_head, next_tail, next_bad) = a, b
        rows = self.length * self.times - 1
        both = tail + next_head
        for i in range(rows, len(both)) if bad is None else ():
            part = [event for _, event in both[i - rows : i + 1]]
            if part == part[: self.length] * self.times and len(set(part[: self.length])) == self.length:
                bad = both[i][0]
                break
        return [(head + next_head)[:rows] if len(head) < rows else head, (tail + next_tail)[-rows:], earliest(bad, next_bad)]

    def verdict(self, a: list | None) -> tuple[bool, int | None]:
        return (True, None) if a is None or a[2] is None else (False, a[2])


Assertion = AtMost | AtLeast | Only | Before | Followed | NoCycle


def _by_key(batches: Iterator[pd.DataFrame], names: list[str], step) -> Iterator[pd.DataFrame]:
    """Stream over rows sorted by their first column: step(state or None, row) gives the next state; (key, state) at the end of a key."""
    now, state = None, None
    for batch in batches:
        done = []
        for row in zip(*[batch[c].tolist() for c in batch.columns]):
            if state is not None and row[0] != now:
                done.append((now, *state))
                state = None
            now, state = row[0], step(state, row)
        if done:
            yield pd.DataFrame(done, columns=names)
    if state is not None:
        yield pd.DataFrame([(now, *state)], columns=names)


def checked(df: DataFrame, key: str, time: str, tie: str, event: str, assertions: dict[str, Assertion]) -> DataFrame:
    """(key, assertion, passed, failed_at): a row for each key and assertion.

    time and tie: longs that order a key's rows (`within` is in units of time). Rows without key, time or event are left
    out; a missing tie comes first; rows equal in all count each. Other columns are not read.
    """
    names, rules = list(assertions), list(assertions.values())
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(time).cast("long").alias("t"), F.coalesce(F.col(tie).cast("long"), F.lit(-(2**63))).alias("tie"), F.col(event).cast("string").alias("event"))
    rows = rows.where("key IS NOT NULL AND t IS NOT NULL AND event IS NOT NULL")
    dealt = rows.repartitionByRange("key", "t", "tie", "event").sortWithinPartitions("key", "t", "tie", "event")

    def taken(state: tuple | None, row: tuple) -> tuple:
        _, t, tie, event = row
        first, found = state or ((t, tie, event), [None] * len(rules))
        for i, rule in enumerate(rules):
            new = rule.one(t, event)
            if new is not None:
                found[i] = new if found[i] is None else rule.join(found[i], new)
        return first, found

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for done in _by_key(batches, ["key", "first", "found"], taken):
            first = pd.DataFrame(done["first"].tolist(), columns=["t", "tie", "event"])
            yield first.assign(key=done["key"], found=[json.dumps(x) for x in done["found"]])[["key", "t", "tie", "event", "found"]]

    parts = dealt.mapInPandas(summed, "key long, t long, tie long, event string, found string")
    parts = parts.repartition("key").sortWithinPartitions("key", "t", "tie", "event").select("key", "found")

    def both(state: tuple | None, row: tuple) -> tuple:
        found = json.loads(row[1])
        if state is None:
            return (found,)
        return ([b if a is None else a if b is None else rule.join(a, b) for rule, a, b in zip(rules, state[0], found)],)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for done in _by_key(batches, ["key", "found"], both):
            out = [(k, name, *rule.verdict(x)) for k, found in zip(done["key"], done["found"]) for name, rule, x in zip(names, rules, found)]
            yield pd.DataFrame(out, columns=["key", "assertion", "passed", "failed_at"]).astype({"failed_at": "Int64"})

    out = parts.mapInPandas(told, "key long, assertion string, passed boolean, failed_at long")
    return out.withColumnRenamed("key", key)
