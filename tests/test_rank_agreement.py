"""Kendall's tau-b by inversions against counting pairs, with ties and groups of any size."""

import math
import random

from lapwise.operators.estimators import kendall_tau


def plain(rows):
    s = lambda x: (x > 0) - (x < 0)
    pairs = [(s(a[0] - b[0]), s(a[1] - b[1])) for i, a in enumerate(rows) for b in rows[:i]]
    down = math.sqrt(sum(abs(x) for x, _ in pairs) * sum(abs(y) for _, y in pairs))
    return sum(x * y for x, y in pairs) / down if down else None


def test_equal_to_counting_pairs(spark):
    rng = random.Random(9)
    groups = {"ties": [(rng.randrange(6), rng.randrange(4)) for _ in range(120)], "apart": [(rng.random(), rng.random()) for _ in range(90)], "same": [(i, i) for i in range(40)], "turned": [(i, -i) for i in range(33)], "flat": [(1, i) for i in range(5)], "two": [(1, 2), (3, 1)], "one": [(1, 1)]}
    rows = [(g, float(a), float(b)) for g, values in groups.items() for a, b in values] + [("two", None, 1.0)]
    found = {r["g"]: r["tau"] for r in kendall_tau(spark.createDataFrame(rows, "g string, a double, b double").repartition(3), ["g"], "a", "b").collect()}
    assert found.keys() == groups.keys() - {"one"}
    for g in found:
        wanted = plain(groups[g])
        assert found[g] is None if wanted is None else abs(found[g] - wanted) < 1e-12, g


def test_rows_grow_as_n_log_n(spark):
    """20,000 rows of one group: 200 million pairs are not made."""
    rows = spark.range(20_000).selectExpr("0 AS g", "double(id) AS a", "double(xxhash64(id)) AS b")
    assert abs(kendall_tau(rows, ["g"], "a", "b").first()["tau"]) < 0.02
