"""Overlapping windows over contigs and parsing of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard chromosomes (fixed values).
CHROMOSOMES = tuple(f"chr{i}" for i in [*range(1, 23), "X", "Y"])


def window_count(length: Column, window: int, overlap: int) -> Column:
    """0 for an empty contig, 1 up to the window, else as many steps as reach the end."""
    step = window - overlap
    return F.when(length <= 0, 0).when(length <= window, 1).otherwise(F.ceil((length - window) / F.lit(float(step))) + 1).cast("long")


def tile_windows(contigs: DataFrame, chrom: str = "chrom", length: str = "len", window: int = 1000, overlap: int = 50) -> DataFrame:
    """(chrom, idx, ws, we): 1-based closed windows; the last is cut at the contig's end."""
    if not 0 <= overlap < window:
        raise ValueError("overlap must be less than the window")
    step = window - overlap
    n = window_count(F.col(length), window, overlap)
    out = contigs.select(F.col(chrom).alias("chrom"), F.col(length).cast("long").alias("len_"), F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))).alias("idx"))
    start = F.col("idx") * step + 1
    return out.select("chrom", F.col("idx").cast("int").alias("idx"), start.alias("ws"), F.least(start + window - 1, F.col("len_")).alias("we"))


def parse_regions(lines: DataFrame, value: str = "value", chroms: tuple[str, ...] | None = CHROMOSOMES, keep=()) -> DataFrame:
    """(region, chrom, start, end, safe_name) of lines chr:start-end; blank, comment and malformed lines are dropped, and chromosomes not listed."""
    text = F.trim(F.col(value))
    p = r"^([^:]+):([0-9]+)-([0-9]+)$"
    out = lines.select(*keep, text.alias("region")).where("region <> '' and not startswith(region, '#')").where(F.col("region").rlike(p))
    out = out.select(*keep, "region", F.regexp_extract("region", p, 1).alias("chrom"), F.regexp_extract("region", p, 2).try_cast("int").alias("start"), F.regexp_extract("region", p, 3).try_cast("int").alias("end"))
    out = out.where("start is not null and end is not null")
    if chroms:
        out = out.where(F.col("chrom").isin(*chroms))
    return out.withColumn("safe_name", F.translate("region", ":-", "__"))
