"""Cluster bootstrap and sign flips against plain loops with the same draws."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from quern.operators.resampling import ONE_BY_ONE, cluster_test, poisson_bounds


def number(key, seed):
    return int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:12], 16) / 16**12


def half_up(x):
    return math.copysign(math.floor(abs(x) + 0.5), x)


def plain(rows, times):
    sums, sizes = defaultdict(float), Counter()
    for c, v in rows:
        if c is not None and v is not None:
            sums[c] += v
            sizes[c] += 1
    kinds = Counter((round(sums[c], 9), sizes[c]) for c in sizes)
    n, total = sum(sizes.values()), sum(sums.values())
    normal = lambda k, a, b: math.sqrt(-2 * math.log(1 - number(k, a))) * math.cos(2 * math.pi * number(k, b))
    means, far = [], 0
    for r in range(times):
        ws = wm = fs = 0.0
        for (s, m), many in kinds.items():
            for j in range(1, many + 1 if many <= ONE_BY_ONE else 2):
                k = f"{r}:{round(s * 10**9)}:{m}:{j}"
                if many <= ONE_BY_ONE:
                    w, f = sum(number(k, "weight") >= b for b in poisson_bounds()), 1 if number(k, "sign") < 0.5 else -1
                else:
                    w = max(half_up(many + math.sqrt(many) * normal(k, "radius", "angle")), 0)
                    f = 2 * min(max(half_up(many / 2 + math.sqrt(many) / 2 * normal(k, "radius2", "angle2")), 0), many) - many
                ws, wm, fs = ws + w * s, wm + w * m, fs + f * s
        if wm:
            means.append(round(ws / wm, 6))
        far += abs(fs) >= abs(total) - 1e-9
    means.sort()
    rank = lambda q: means[max(math.ceil(q * len(means)), 1) - 1]
    return n, len(sizes), round(total / n, 6), rank(0.025), rank(0.975), round((far + 1) / (times + 1), 6)


def rows_of(sizes, value):
    return [(c, value(c, i)) for c, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        rows_of([3, 1, 4, 1, 5, 9, 2, 6], lambda c, i: [1.0, -1.0, 0.0, 0.5][(c * 7 + i * 3) % 4]),
        rows_of([2] * 90 + [5] * 3, lambda c, i: 1.0 if (c + i) % 3 else -1.0) + [(None, 1.0), (3, None)],
    ],
)
def test_as_plain_loops(spark, rows):
    df = spark.createDataFrame(rows, "c long, v double").repartition(3)
    found = cluster_test(df, "c", "v", 300).collect()
    assert len(found) == 1
    assert tuple(found[0]) == pytest.approx(plain(rows, 300), abs=2e-6)


def test_rows_say_more_than_their_clusters(spark):
    """200 rows, better in 30 and worse in none, look sure; all 30 come from one conversation of twenty: nothing is sure."""
    rows = [(i // 10 if i >= 30 else 0, 1.0 if i < 30 else 0.0, i) for i in range(200)]
    df = spark.createDataFrame(rows, "conv long, v double, row long")
    by_row, by_conv = (cluster_test(df, c, "v", 1000).first() for c in ("row", "conv"))
    assert by_row.delta == by_conv.delta == 0.15
    assert by_row.low > 0 and by_row.p_value < 0.01 and by_row.n_clusters == 200
    assert by_conv.low == 0 and by_conv.p_value == 1 and by_conv.n_clusters == 18


def test_no_rows(spark):
    none = spark.createDataFrame([], "c long, v double")
    assert [tuple(r) for r in cluster_test(none, "c", "v", 50).collect()] == [(0, 0, None, None, None, 1.0)]
