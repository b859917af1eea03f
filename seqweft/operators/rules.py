"""Data-quality rules as rows of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(df: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """(keys, code) of every rule that a row breaks; one scan for all rules."""
    made = F.filter(F.array(*(F.when(c, F.lit(code)) for code, c in rules.items())), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(made).alias("code"))


def slice_rules(mv_off: str, mv_len: str, mv_size: str, sig_off: str, sig_len: str, sig_size: str, stride: str, seq_len: str | None = None, moved: str | None = None) -> dict[str, Column]:
    """The rules of one read's slices against their arrays."""
    c = F.col
    out = {
        "stride_mismatch": c(mv_len) * c(stride) != c(sig_len),
        "mv_offset_negative": c(mv_off) < 0,
        "mv_len_negative": c(mv_len) < 0,
        "mv_slice_oob": (c(mv_off) >= 0) & (c(mv_len) >= 0) & (c(mv_off) + c(mv_len) > c(mv_size)),
        "signal_offset_negative": c(sig_off) < 0,
        "signal_length_negative": c(sig_len) < 0,
        "signal_slice_oob": (c(sig_off) >= 0) & (c(sig_len) >= 0) & (c(sig_off) + c(sig_len) > c(sig_size)),
    }
    if seq_len:
        out["missing_fastq"] = c(seq_len).isNull()
        out["sequence_length_mismatch"] = c(seq_len) != c(moved)
    return out


def cut_rules(mv_off: str, mv_len: str, moves: str, sig_off: str, sig_len: str, signal: str) -> dict[str, Column]:
    """Slices that come out shorter than they should, from the arrays themselves."""

    def short(off, length, values):
        have = F.greatest(F.lit(0), F.least(F.size(values) - F.col(off), F.col(length)))
        return (F.col(off) >= 0) & (F.col(length) >= 0) & (have != F.col(length))

    return {"mv_slice_len": short(mv_off, mv_len, moves), "signal_slice_len": short(sig_off, sig_len, signal)}


def range_issues(df: DataFrame, segment: str, offset: str, length: str, size: str, prefix: str, slice_rows: int | None = None) -> DataFrame:
    """(segment, code, n) of segments whose slices do not cover the array: prefix_unused_prefix, _gap, _overlap, _unused_tail; n letters each.

    Segments with a slice outside the array are left to the slice rules.
    """
    from .ordered import contiguity

    x = df.select(segment, F.col(offset).alias("from_"), (F.col(offset) + F.col(length)).alias("to_"), F.col(size).alias("size_"))
    bad = (F.col("from_") < 0) | (F.col("to_") < F.col("from_")) | (F.col("to_") > F.col("size_"))
    x = whole_segments(x, segment, ~bad)
    c = contiguity(x, segment, "from_", "to_", "size_", slice_rows)
    found = F.array(*(F.struct(F.lit(f"{prefix}_{code}").alias("code"), F.col(n).cast("long").alias("n")) for code, n in (("unused_prefix", "first_start"), ("gap", "gap_total"), ("overlap", "overlap_total"), ("unused_tail", "unused_tail"))))
    return c.select(segment, F.explode(F.filter(found, lambda e: e["n"] > 0)).alias("e")).select(segment, "e.*")


def load_issues(expected: DataFrame, found: DataFrame, segment: str, kinds: tuple[str, ...]) -> DataFrame:
    """(segment, code) for each kind of file that a segment should have and does not: found has (segment, kind)."""
    want = expected.select(segment, F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return want.join(found.select(segment, "kind"), [segment, "kind"], "left_anti").select(segment, F.concat("kind", F.lit("_load_error")).alias("code"))


def health_rules(values: Column, prefix: str) -> dict[str, Column]:
    """NaN and infinities in an array of doubles, and an array without values."""
    inf = float("inf")
    return {
        f"{prefix}_nan": F.exists(values, lambda x: F.isnan(x)),
        f"{prefix}_posinf": F.exists(values, lambda x: x == F.lit(inf)),
        f"{prefix}_neginf": F.exists(values, lambda x: x == F.lit(-inf)),
        f"{prefix}_empty": F.coalesce(F.size(values), F.lit(0)) <= 0,
    }


def whole_segments(df: DataFrame, segment: str, ok: Column) -> DataFrame:
    """Rows of segments in which every row is ok."""
    bad = df.where(~F.coalesce(ok, F.lit(False))).select(segment).distinct()
    return df.join(bad, segment, "left_anti")
