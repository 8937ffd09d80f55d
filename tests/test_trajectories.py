"""Assertions over ordered events against plain loops, however the rows are dealt."""

import random

import pytest

from quern.operators.trajectories import AtLeast, AtMost, Before, Followed, NoCycle, Only, checked

RULES = {
    "never_d": AtMost("d"),
    "at_most_two_a": AtMost("a", 2),
    "two_b": AtLeast("b", 2),
    "only": Only(("a", "b", "c")),
    "a_before_b": Before("a", "b"),
    "a_before_a": Before("a", "a"),
    "b_soon": Followed("a", "b", 5),
    "a_again": Followed("a", "a", 3),
    "no_pair": NoCycle(2, 2),
    "no_triple": NoCycle(3, 2),
    "no_three_in_a_row": NoCycle(1, 3),
}


def plain(rows, rule):
    """rows: (t, event) in order."""
    if isinstance(rule, AtMost):
        at = [t for t, e in rows if e == rule.event]
        return (False, at[rule.n]) if len(at) > rule.n else (True, None)
    if isinstance(rule, AtLeast):
        return sum(e == rule.event for _, e in rows) >= rule.n, None
    if isinstance(rule, Only):
        bad = [t for t, e in rows if e not in rule.events]
    elif isinstance(rule, Before):
        bad = [t for i, (t, e) in enumerate(rows) if e == rule.event and all(x != rule.first for _, x in rows[:i])]
    elif isinstance(rule, Followed):
        bad = [t for i, (t, e) in enumerate(rows) if e == rule.event and not any(x == rule.by and u - t <= rule.within for u, x in rows[i + 1 :])]
    else:
        p, size = rule.length, rule.length * rule.times
        runs = [(rows[i + size - 1][0], [e for _, e in rows[i : i + size]]) for i in range(len(rows) - size + 1)]
        bad = [t for t, r in runs if all(r[j] == r[j - p] for j in range(p, size)) and len(set(r[:p])) == p]
    return (False, bad[0]) if bad else (True, None)


@pytest.mark.parametrize("seed,partitions", [(1, "1"), (2, "7"), (3, "40")])
def test_as_plain_loops(spark, seed, partitions):
    r = random.Random(seed)
    rows = []
    for key in range(40):
        n, letters = (r.choice([1, 2, 5, 12]), r.choice(["ab", "abc", "abcd", "aab"]))
        n = 150 if key == 7 else n  # a hot key over many tasks
        t = 0
        for _ in range(n):
            t += r.choice([0, 1, 1, 2, 6])
            rows.append((key, t, len(rows), r.choice(letters)))
    rows += [(50, i, i, e) for i, e in enumerate("abab")] + [(51, i, i, e) for i, e in enumerate("abcabc")] + [(52, i, i, e) for i, e in enumerate("aaa")]
    wanted = {}
    for key in {x[0] for x in rows}:
        own = [(t, e) for k, t, _, e in sorted(rows) if k == key]
        wanted |= {(key, name): plain(own, rule) for name, rule in RULES.items()}
    odd = [(None, 1, 1, "d"), (1, None, 1, "d"), (1, 1, 1, None), (1, None, None, None)]
    mixed = rows + odd
    r.shuffle(mixed)
    df = spark.createDataFrame([(*x, True) for x in mixed], "conv long, at long, id long, what string, passed boolean").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {(x.conv, x.assertion): (x.passed, x.failed_at) for x in checked(df, "conv", "at", "id", "what", RULES).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == wanted
    assert {ok for ok, _ in wanted.values()} == {True, False}


def test_summaries_join_the_same_in_any_grouping():
    r = random.Random(9)
    for _ in range(300):
        rows = [(t, r.choice("abcd")) for t in sorted(r.randrange(30) for _ in range(r.randint(1, 14)))]
        for rule in RULES.values():
            parts = [rule.one(*x) for x in rows]
            while len(parts) > 1:
                i = r.randrange(len(parts) - 1)
                a, b = parts[i : i + 2]
                parts[i : i + 2] = [b if a is None else a if b is None else rule.join(a, b)]
            assert rule.verdict(parts[0]) == plain(rows, rule)


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv long, at long, id long, what string")
    assert checked(none, "conv", "at", "id", "what", RULES).columns == ["conv", "assertion", "passed", "failed_at"]
    assert checked(none, "conv", "at", "id", "what", RULES).count() == 0
