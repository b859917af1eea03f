"""Positional arrays: round trip, slices, places in the whole, failed tasks and broken files."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan

from seqweft.sources import arrays

SCHEMA = "chr string, read_id long, signal array<int>, moves array<int>"


def rows(n=300, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        signal = [rnd.randint(-32768, 32767) for _ in range(rnd.choice([0, 1, 7, 200]))]
        out.append((f"chr{rnd.randint(1, 4)}", i, signal if i % 11 else None, [rnd.randint(0, 1) for _ in range(len(signal) // 2)]))
    return out


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("arrays") / "set")
    arrays.write_arrays(spark.createDataFrame(rows(), SCHEMA).repartition(5), path, {"signal": "i2", "moves": "i1"}, ["chr", "read_id"], 5)
    return path


def test_round_trip_and_places(spark, written):
    want = sorted(rows(), key=lambda r: (r[0], r[1]))
    got = arrays.read_arrays(spark, written).orderBy("chr", "read_id").collect()
    assert [(r.chr, r.read_id, r.signal, r.moves) for r in got] == want
    at = {"signal": 0, "moves": 0}
    for r, w in zip(got, want, strict=True):
        for c, v in (("signal", w[2]), ("moves", w[3])):
            assert (r[f"{c}_offset"], r[f"{c}_len"]) == (at[c], None if v is None else len(v))
            at[c] += len(v or ())
    whole = np.concatenate([np.array(w[2] or [], "i2") for w in want])
    for a, z in ((0, len(whole)), (17, 4_000), (len(whole) - 3, len(whole) + 9), (5, 5)):
        assert arrays.read_range(written, "signal", a, z).tolist() == whole[a:z].tolist()
    assert len(arrays.manifest(written)["parts"]) > 1
    assert arrays.array_gaps(spark, written).count() == 0


def test_a_filter_reads_its_slices(spark, written):
    got = arrays.read_arrays(spark, written).where("chr = 'chr2' and read_id > 250")
    assert sorted(r.read_id for r in got.collect()) == [r[1] for r in rows() if r[0] == "chr2" and r[1] > 250]
    source = arrays.PositionalArrays({"path": written})
    reader = source.reader(source.schema())
    list(reader.pushFilters([EqualTo(("chr",), "chr2"), GreaterThan(("read_id",), 250)]))
    n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    size = sum(len(r[2] or ()) * 2 + len(r[3]) for r in rows() if r[0] == "chr2" and r[1] > 250)
    assert n and size <= reader.bytes_read <= 2 * size < sum(len(r[2] or ()) * 2 + len(r[3]) for r in rows()) / 5


def test_failed_tasks_leave_nothing_visible(spark, written, tmp_path):
    before = sorted(os.listdir(written))
    bad = spark.createDataFrame([*rows(50), ("chr9", 999, [40_000], [1])], SCHEMA).repartition(4)
    with pytest.raises(Exception, match="do not fit"):
        arrays.write_arrays(bad, written, {"signal": "i2", "moves": "i1"}, ["chr", "read_id"])
    assert arrays.read_arrays(spark, written).count() == 300
    listed = {p["name"] for p in arrays.manifest(written)["parts"]}
    assert {x for x in before if x.split(".")[0] in listed} <= set(os.listdir(written))
    fresh = str(tmp_path / "fresh")
    with pytest.raises(Exception, match="do not fit"):
        arrays.write_arrays(bad, fresh, {"signal": "i2", "moves": "i1"}, ["chr", "read_id"])
    with pytest.raises(Exception, match="no arrays"):
        arrays.read_arrays(spark, fresh).count()


def test_overwriting_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "set")
    for n in (40, 10):
        arrays.write_arrays(spark.createDataFrame(rows(n), SCHEMA), path, {"signal": "i2", "moves": "i1"}, ["read_id"])
        assert arrays.read_arrays(spark, path).count() == n
    names = {p["name"] for p in arrays.manifest(path)["parts"]}
    assert {x.split(".")[0] for x in os.listdir(path) if x.startswith("part-")} == names
    arrays.write_arrays(spark.createDataFrame([], SCHEMA), path, {"signal": "i2", "moves": "i1"}, ["read_id"])
    assert arrays.manifest(path)["parts"] == [] and arrays.array_gaps(spark, path).count() == 0
    assert arrays.read_range(path, "signal", 0, 10).tolist() == []


def test_broken_files_are_found(spark, tmp_path):
    path = str(tmp_path / "set")
    df = spark.createDataFrame(rows(60), SCHEMA).select("read_id", F.col("signal").cast("array<double>").alias("signal"))
    arrays.write_arrays(df, path, {"signal": "f4"}, ["read_id"])
    assert [r.signal for r in arrays.read_arrays(spark, path).orderBy("read_id").collect()] == [None if r[2] is None else [float(x) for x in r[2]] for r in rows(60)]
    name = next(p["name"] for p in arrays.manifest(path)["parts"] if p["sizes"]["signal"])
    os.truncate(f"{path}/{name}.signal.bin", 8)
    assert [(r.name, r.problem) for r in arrays.array_gaps(spark, path).collect()] == [(name, "file")]
    with pytest.raises(Exception, match="ends before"):
        arrays.read_arrays(spark, path).collect()
