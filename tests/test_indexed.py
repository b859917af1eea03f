"""Indexed scans of sorted SAM text against full scans, with the bytes that were read."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

from seqweft.sources import formats, indexed


def sam(path, n=4_000, header=True, order=("chr1", "chr2", "chrX", "chrUn")):
    rnd = random.Random(7)
    rows = [(rnd.choice(order), rnd.randint(1, 100_000)) for _ in range(n)]
    rows.sort(key=lambda r: (order.index(r[0]), r[1]))
    with open(path, "w") as f:
        if header:
            f.write("@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:100000\n")
        for k, (c, p) in enumerate(rows):
            cigar = rnd.choice(["10M", "5M20D5M", "3S7M", "4M100N6M", "*"])
            f.write(f"r{k}\t{rnd.choice([0, 16])}\t{c}\t{p}\t60\t{cigar}\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII" + ("\tNM:i:0\tmv:B:c,5,1,0" if k % 3 else "") + ("\r\n" if k % 50 == 0 else "\n"))
    return str(path)


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    return sam(tmp_path_factory.mktemp("sam") / "reads.sam")


def full(spark, path):
    out = formats.read_sam(spark, path).drop("path", "block", "row").collect()
    take = {"M", "D", "N", "=", "X"}
    return [(r.qname, r.flag, r.chrom, r.pos, r.pos + (sum(x["len"] for x in r.cigar or [] if x["op"] in take) or 1), r.mapq, r.seq, r.qual, tuple(r.tags)) for r in out]


def rows(df):
    return sorted((r.qname, r.flag, r.chrom, r.pos, r.end, r.mapq, r.seq, r.qual, tuple(r.tags)) for r in df.collect())


@pytest.mark.parametrize(("block", "split"), [(2_000, 9_000), (1 << 18, 32 << 20), (1, 777)])
def test_rows_equal_the_full_scan(spark, file, block, split, tmp_path):
    index = indexed.index_sam(spark, file, str(tmp_path / "index"), block, split)
    everything = full(spark, file)
    assert rows(indexed.read_indexed_sam(spark, file, index, split)) == sorted(everything)
    for chrom, a, z in (("chr2", 50_000, 51_000), ("chr1", 0, 500), ("chrUn", 99_000, 200_000), ("chr1", 30, 30), ("none", 0, 10)):
        got = indexed.region_scan(spark, file, chrom, a, z, index)
        assert rows(got) == sorted(r for r in everything if r[2] == chrom and r[3] < z and r[4] > a)


def reader_of(file, index, *filters):
    reader = indexed.SortedSam({"path": file, "index": index, "split": "20000"}).reader(None)
    assert list(reader.pushFilters(filters)) == list(filters)
    return reader


def test_a_region_reads_only_its_ranges(spark, file, tmp_path):
    index = indexed.index_sam(spark, file, str(tmp_path / "index"), 2_000, 50_000)
    size = os.path.getsize(file)
    reader = reader_of(file, index, EqualTo(("chrom",), "chr2"), LessThan(("pos",), 51_000), GreaterThan(("end",), 50_000))
    parts = reader.partitions()
    found = sum(b.num_rows for p in parts for b in reader.read(p))
    planned = sum(p.end - p.begin for p in parts)
    assert found and planned <= 6_000 and reader.bytes_read <= planned + len(parts) < size / 40
    whole = reader_of(file, index)
    assert sum(b.num_rows for p in whole.partitions() for b in whole.read(p)) == 4_000 and whole.bytes_read <= size + 4_000
    contig = reader_of(file, index, EqualTo(("chrom",), "chrX"))
    assert sum(p.end - p.begin for p in contig.partitions()) < size / 3
    plan = indexed.region_scan(spark, file, "chr2", 50_000, 51_000, index)
    assert plan.select("block").distinct().count() <= 2


def test_reading_ends_behind_the_contigs(spark, file):
    size = os.path.getsize(file)
    got = indexed.scan_until(spark, file, ["chr1", "chr2"], 30_000)
    assert rows(got) == sorted(r for r in full(spark, file) if r[2] in ("chr1", "chr2"))
    ranges = "\n".join(f"{file}:{at}:{min(size, at + 30_000)}" for at in range(0, size, 30_000))
    reader = indexed.SortedSam({"path": file, "contigs": "chr1", "ranges": ranges}).reader(None)
    old, indexed.CHUNK = indexed.CHUNK, 1_000
    try:
        n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    finally:
        indexed.CHUNK = old
    assert n == sum(r[2] == "chr1" for r in full(spark, file)) and reader.bytes_read < size / 2


def test_what_is_not_there_or_not_sorted(spark, file, tmp_path):
    with pytest.raises(Exception, match="no index"):
        indexed.read_indexed_sam(spark, file, str(tmp_path / "none")).count()
    lines = open(file).read().splitlines(True)
    back = tmp_path / "back.sam"
    back.write_text("".join(lines[:2] + lines[100:110] + lines[50:60]))
    with pytest.raises(Exception, match="not sorted"):
        indexed.index_sam(spark, str(back))
    again = tmp_path / "again.sam"
    again.write_text("".join([*lines[:2], lines[10], lines[-1], lines[11]]))
    with pytest.raises(Exception, match="more than once"):
        indexed.index_sam(spark, str(again))
    with pytest.raises(Exception, match="no header"):
        indexed.index_sam(spark, sam(tmp_path / "bare.sam", 10, False))
    with pytest.raises(ValueError, match="compressed"):
        indexed.index_sam(spark, str(tmp_path / "x.sam.gz")) if (tmp_path / "x.sam.gz").write_bytes(b"x") else None


def test_empty_and_folders(spark, tmp_path):
    only = tmp_path / "header.sam"
    only.write_text("@HD\tVN:1.6\n")
    index = indexed.index_sam(spark, str(only))
    assert indexed.read_indexed_sam(spark, str(only), index).count() == 0
    rows_ = spark.range(500).select(F.concat(F.lit("r"), "id").alias("qname"), F.lit(0).alias("flag"), (F.col("id") % 7).cast("string").alias("chrom"), (F.col("id") * 13 % 400).alias("pos"), F.lit(60).alias("mapq"), F.lit("4M").alias("cigar"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"))
    folder = str(tmp_path / "parts")
    indexed.write_sorted_sam(rows_, folder)
    index = indexed.index_sam(spark, folder, header=False, block=100)
    assert indexed.region_scan(spark, folder, "3", 100, 200, index).count() == rows_.where("chrom = '3' and pos < 200 and pos + 4 > 100").count()
