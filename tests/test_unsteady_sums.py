"""Values that each pass makes anew, as sums over a shuffle do, with other last digits."""

import math
import os
import statistics

from pyspark.sql import functions as F

from lapwise.operators import estimators as A, shaping as S


def unsteady(spark, n):
    """id, x and y of n rows, whose doubles move by one unit in the last place from one run of the plan to the next."""
    moved = F.udf(lambda v: math.nextafter(v, math.inf * (os.urandom(1)[0] % 2 * 2 - 1)), "double").asNondeterministic()
    return spark.range(n).select("id", moved(F.col("id") + 0.1).alias("x"), moved(n - F.col("id") + 0.3).alias("y"))


def test_quantile_of_unsteady_values(spark):
    df = unsteady(spark, 4)
    assert all(math.isclose(A.exact_quantile(df, "x", 0.5), statistics.median([0.1, 1.1, 2.1, 3.1])) for _ in range(12))


def test_quadrants_of_unsteady_values(spark):
    """Of 21 values 11 are no less than their median, the one that is the median among them."""
    for _ in range(4):
        found = S.quadrant(unsteady(spark, 21), "x", "y").collect()
        assert {(r["id"] >= 10, r["id"] <= 10) for r in found if r["quadrant"] == "high_right"} == {(True, True)}
        assert sum(r["quadrant"].startswith("high") for r in found) == sum(r["quadrant"].endswith("right") for r in found) == 11
