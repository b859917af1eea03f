"""Hot keys: selection of medians, chains of near qualities and stitched chunks against plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from seqweft.operators import metrics, ordered, records


@pytest.mark.parametrize(("slice_rows", "passes"), [(None, 2), (5, 2), (0, 0), (1, 1)])
def test_lower_medians(spark, slice_rows, passes):
    rnd = random.Random(6)
    parts = {"one": [3.0], "two": [1.0, 2.0], "same": [7.0] * 50, "many": [rnd.gauss(0, 1) for _ in range(501)], "ends": [-1e308, 1e308, 1e308, -1e308, 0.0, 5e-324], "powers": [2.0 ** rnd.randint(-300, 300) for _ in range(300)], None: [2.0, 9.0, 4.0]}
    df = spark.createDataFrame([(p, v) for p, vs in parts.items() for v in vs] + [("one", None), ("none", None)], "p string, v double").repartition(3)
    got = {r.p: r["median_"] for r in metrics.lower_medians(df, "p", "v", slice_rows, passes).collect()}
    assert got == {p: sorted(v)[(len(v) - 1) // 2] for p, v in parts.items()}


def test_chains_of_near_qualities(spark):
    rows = [("r", "a", 30.0, 1, 5), ("r", "b", 29.9, 9, 5), ("r", "c", 29.5, 9, 7), ("r", "d", 28.9, 60, 9), ("r", "e", 28.4, 60, 10), ("r", "f", 27.0, 60, 99), ("r", "g", None, 60, 99), ("s", "h", 29.99, 1, 1), ("s", "i", 29.5, 2, 1), (None, "j", 1.0, 1, 1)]
    df = spark.createDataFrame(rows, "region string, id string, q double, mapq int, len int")
    got = lambda k: [r.id for r in records.best_reads(df, "region", "q", "mapq", "len", "id", k).orderBy("region", "rank").collect()]
    # 30.0, 29.9 and 29.5 are one chain, as each is within 0.5 of the one before; 28.9 and 28.4 the next
    assert got(4) == ["j", "c", "b", "a", "e", "i", "h"]
    assert got(9) == ["j", "c", "b", "a", "e", "d", "f", "g", "i", "h"]
    assert records.best_reads(df, "region", "q", "mapq", "len", "id", 2).columns == ["region", "id", "q", "mapq", "len", "rank"]


@pytest.mark.parametrize(("chunk", "slice_rows"), [(7, 4), (1_000, 1_000_000), (1, 2)])
def test_chunks_are_the_stitched_sequence(spark, chunk, slice_rows):
    rnd = random.Random(chunk)
    rows = [(p, i, "" if rnd.random() < 0.15 else "".join(rnd.choice("ACGT") for _ in range(rnd.randint(1, 12)))) for p in ("x", "y", None) for i in range(0, 60)]
    df = spark.createDataFrame([*rows, ("x", 90, None), ("z", 5, "AC")], "p string, i long, s string").withColumn("a", F.col("i")).repartition(3)
    want = {(r.p, r.first_idx): r.sequence for r in ordered.stitch(df, "p", "i", "s", 3, "a", "a").collect()}
    made: dict = {}
    for r in ordered.stitch_chunks(df, "p", "i", "s", 3, chunk, slice_rows).orderBy("chunk").collect():
        made.setdefault((r.p, r.first_idx), []).append(r.sequence)
    assert {k: "".join(v) for k, v in made.items()} == want
    assert all(len(x) == chunk for v in made.values() for x in v[:-1])


def test_missing_keys_are_errors(spark):
    from seqweft.operators import keyed

    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    names = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, name string")
    assert {(r.v, r.name) for r in keyed.mapped(df.where("k is not null"), names, "k").collect()} == {(1, "x"), (2, "y")}
    with pytest.raises(Exception, match="no name for null"):
        keyed.mapped(df, names, "k", "name").collect()
    assert keyed.allowed(df, ["a", "a"], "k").count() == 1
    with pytest.raises(Exception, match="1 keys are missing"):
        keyed.allowed(df, ["a", "z"], "k").collect()
    twice = df.union(df.where("k = 'a'").withColumn("v", F.lit(0)))
    assert [(r.k, r.v) for r in keyed.first_present(twice, names, "k", "v").orderBy("k").collect()] == [("a", 0), ("b", 2)]


def test_collated_rows_have_masks(spark):
    df = spark.createDataFrame([("p", 1, [1.0, 2.0]), ("p", 2, None), ("q", 3, []), (None, 4, [5.0])], "part string, id int, v array<double>")
    got = {r.id: (r.v, r.padding) for r in metrics.collated(df, "part", "v").collect()}
    assert got == {1: ([1.0, 2.0], [False, False]), 2: ([0.0, 0.0], [True, True]), 3: ([], []), 4: ([5.0], [False])}


def test_checked_chunks_are_the_checked_fold(spark):
    from seqweft.operators import assembly

    rnd = random.Random(12)
    rows = []
    for p in ("x", "y"):
        whole = "".join(rnd.choice("ACGT") for _ in range(4_000))
        for i in range(80):
            s = whole[i * 40 : i * 40 + 60]  # overlaps of 20 letters
            if rnd.random() < 0.3:
                at = rnd.randrange(20)
                s = s[:at] + rnd.choice(["", "A", "ACGT" * 3]) + s[at + 1 :]
            rows.append((p, i, "" if rnd.random() < 0.05 else s))
    df = spark.createDataFrame(rows, "p string, i long, s string").repartition(3)
    want = {(r.p, r.first_idx): r.sequence for r in assembly.stitch_checked(df, "p", "i", "s", 20).collect()}
    assert len(want) > 10
    made: dict = {}
    for r in ordered.stitch_chunks(df, "p", "i", "s", 20, 50, 16, checked=True).orderBy("chunk").collect():
        made.setdefault((r.p, r.first_idx), []).append(r.sequence)
    assert {k: "".join(v) for k, v in made.items()} == want
    short = spark.createDataFrame([("x", 0, "ACGTACG"), ("x", 1, "ACGTACGT" * 9)], "p string, i long, s string")
    with pytest.raises(Exception, match="shorter than two overlaps"):
        ordered.stitch_chunks(short, "p", "i", "s", 20, checked=True).collect()
