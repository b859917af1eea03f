"""Interval joins by levels of bins, against a double loop; rows of an interval at any length."""

import random

import pytest
from pyspark.sql import functions as F

from seqweft.operators import intervals


def spans(rnd, n, longest):
    for i in range(n):
        a = rnd.randint(-50, 2_000)
        yield rnd.choice("xyz"), a, a + int(longest ** rnd.random()) - 1, i


@pytest.mark.parametrize("loose", [0, 1, 30])
def test_containing_is_the_double_loop(spark, loose):
    rnd = random.Random(loose)
    outer = [*spans(rnd, 150, 5_000), ("x", 5, 5, 900), ("x", 9, 3, 901), ("y", -1_000_000_000_000, 1_000_000_000_000, 902), ("w", 1, 9, 903)]
    inner = [*spans(rnd, 150, 400), ("x", 5, 5, 900), ("x", 7, 2, 901), ("v", 1, 2, 902)]
    want = sorted((o[3], i[3]) for o in outer for i in inner if o[0] == i[0] and o[1] <= i[1] + loose and o[2] >= i[2] and o[2] >= i[1] and o[2] >= o[1] - loose)
    a = spark.createDataFrame([*outer, ("x", None, 9, 904), (None, 1, 9, 905)], "c string, a long, b long, o int")
    b = spark.createDataFrame([*inner, ("x", None, None, 904), (None, 2, 3, 905)], "c string, s long, e long, i int")
    got = intervals.containing(a, b, "c", ("a", "b"), ("s", "e"), loose)
    assert sorted((r.o, r.i) for r in got.select("o", "i").collect()) == want
    assert got.columns == ["c", "a", "b", "o", "s", "e", "i"]


def test_a_long_interval_is_at_most_two_rows(spark):
    lengths = [1, 2, 3, 4, 5, 1_000, 100_000_000, 1 << 40]
    rows = spark.createDataFrame([("c", a, a + n - 1) for n in lengths for a in (0, 1, 3, n - 1, 12_345)], "c string, a long, b long")
    level = intervals._level(F.col("b") - F.col("a") + 1)
    bins = rows.select("a", "b", (intervals._bin(F.col("b"), level) - intervals._bin(F.col("a"), level)).alias("more")).collect()
    assert {r.more for r in bins} == {0, 1}
    points = intervals.points_in(rows, spark.createDataFrame([("c", 100_000_000), ("c", 12_345)], "c string, p long"), "c", ("a", "b"), "p")
    assert points.count() == sum(a <= p <= a + n - 1 for p in (100_000_000, 12_345) for n in lengths for a in (0, 1, 3, n - 1, 12_345))
