"""Interval joins as equi-joins on bins of several levels, so no pair of tables is joined by a bare inequality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reads_over_windows(reads: DataFrame, windows: DataFrame, step: int) -> DataFrame:
    """Reads (chrom, rstart, rend, ...) that contain windows (chrom, idx, ws, we), 1-based closed.

    Window idx starts at idx * step + 1, so a read's windows are a range of idx worked out by arithmetic.
    """
    first = F.ceil((F.col("rstart") - 1) / F.lit(float(step))).cast("int")
    last = F.floor((F.col("rend") - 1) / F.lit(float(step))).cast("int")
    each = reads.withColumn("idx", F.explode(F.when(last >= first, F.sequence(first, last))))
    return each.join(windows, ["chrom", "idx"]).where("rstart <= ws and rend >= we")


#: A level's bins are this many times as wide as those of the level below, as a power of two.
_STEP = 2
_WIDEST = 62


def _level(length):
    """The lowest level whose bins are at least as wide as an interval of so many places."""
    bits = F.length(F.bin(F.greatest(length - 1, F.lit(0)).cast("long")))  # of the largest distance between two places; 1 for none
    return F.least(F.ceil(bits / F.lit(_STEP)), F.lit(_WIDEST // _STEP)).cast("int")


def _bin(place, level):
    return F.call_function("shiftright", place.cast("long"), level * _STEP)


def containing(outer: DataFrame, inner: DataFrame, on: str, outer_span: tuple[str, str], inner_span: tuple[str, str], loose_left: int = 0) -> DataFrame:
    """Rows of outer whose span contains that of inner: outer start <= inner start + loose_left and outer end >= inner end.

    Levels of bins, each four times as wide as the one before: an outer row stands at the lowest level whose bins are as
    wide as it, in the one or two bins that it touches, so a longer row is not more rows. An inner row asks at each level
    that outer rows of its key have, in the one bin of its start; what it meets there is at most eight times as long as
    a bin of outer rows that reach its start, whatever the mixture of lengths. No pair appears twice. Null ends match nothing, and a start must lie before the outer end even where an inner row ends before it starts.
    """
    a, b = (F.col(c) for c in outer_span)
    s, e = (F.col(c) for c in inner_span)
    begin = a.cast("long") - loose_left
    o = outer.where(a.isNotNull() & (b >= begin)).withColumn("level_", _level(b - begin + 1))
    first, last = _bin(begin, F.col("level_")), _bin(b, F.col("level_"))
    present = o.groupBy(on).agg(F.collect_set("level_").alias("levels_"))
    o = o.withColumn("bin_", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))))
    i = inner.join(present, on).withColumn("level_", F.explode("levels_")).drop("levels_").withColumn("bin_", _bin(s, F.col("level_")))
    return o.join(i, [on, "level_", "bin_"]).where((begin <= s) & (b >= F.greatest(s, e))).drop("level_", "bin_")


def points_in(windows: DataFrame, points: DataFrame, on: str, span: tuple[str, str], point: str) -> DataFrame:
    """Windows joined with the points inside them, both ends included."""
    return containing(windows, points, on, span, (point, point))
