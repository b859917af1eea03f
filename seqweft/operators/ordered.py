"""Window-function operators: offsets, islands, runs, top k, first wins, contiguity, splits."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliced(df: DataFrame, part: str, order: str, rows: int, name: str = "slice_") -> DataFrame:
    """df with a slice for each row: 0 in parts of up to `rows` rows, else by quantiles of order, which grow with it.

    Quantiles are approximate, so slices differ in size, but rows of one order value are never parted. Parts that are
    cut have a row with their quantiles, at most a row for each `rows` rows of df.
    """
    steps = [i / 64 for i in range(1, 64)]
    large = df.groupBy(part).agg(F.count(F.lit(1)).alias("n_"), F.percentile_approx(order, steps, 1000).alias("cuts_")).where(F.col("n_") > rows)
    large = large.select(F.col(part).alias("part_"), "cuts_")
    at = F.size(F.filter("cuts_", lambda c: c < F.col(order)))
    return df.join(large, df[part].eqNullSafe(large["part_"]), "left").withColumn(name, F.when(F.col("cuts_").isNull(), 0).otherwise(at)).drop("part_", "cuts_")


def offset_plan(df: DataFrame, part: str, length: str, order: list, name: str = "offset", slice_rows: int | None = None) -> DataFrame:
    """Exclusive running sum of length in each part.

    With slice_rows, larger parts are cut in slices by their first order column: each slice sums on its own, and the sums
    of the slices before it are joined on, so one part's rows meet in no single task.
    """
    by = [part]
    if slice_rows:
        df = sliced(df, part, order[0], slice_rows)
        by = [part, "slice_"]
        sums = df.groupBy(*by).agg(F.sum(length).alias("sum_"))
        before = Window.partitionBy(part).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(F.col(part).alias("part_"), F.col("slice_").alias("at_"), F.sum("sum_").over(before).alias("before_"))
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn(name, F.coalesce(F.sum(length).over(w), F.lit(0)))
    if slice_rows:
        out = out.join(sums, out[part].eqNullSafe(sums["part_"]) & (out["slice_"] == sums["at_"]))
        out = out.withColumn(name, F.col(name) + F.coalesce("before_", F.lit(0))).drop("part_", "at_", "before_", "slice_")
    return out


def numbered(df: DataFrame, part: str, order: list, name: str, slice_rows: int | None = None) -> DataFrame:
    """The row's number in its part, from 1; slice_rows as in offset_plan."""
    if not slice_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    one = df.withColumn("one_", F.lit(1).cast("long"))
    return offset_plan(one, part, "one_", order, name, slice_rows).withColumn(name, F.col(name) + 1).drop("one_")


def stitch(df: DataFrame, part: str, idx: str, seq: str, overlap: int, start: str, end: str) -> DataFrame:
    """Runs of consecutive indices with non-empty sequences, joined: the first whole, each later one past its overlap.

    Returns part, first_idx, last_idx, seg_start, seg_end, sequence.
    """
    kept = df.where(F.coalesce(F.length(seq), F.lit(0)) > 0)
    island = F.col(idx) - F.row_number().over(Window.partitionBy(part).orderBy(idx))
    one = F.struct(F.col(idx).alias("i"), F.col(seq).alias("s"), F.col(start).alias("a"), F.col(end).alias("b"))
    g = kept.withColumn("island_", island).groupBy(part, "island_").agg(F.sort_array(F.collect_list(one)).alias("x"))
    tail = F.transform(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), lambda e: F.substring(e["s"], overlap + 1, 1 << 30))
    last = F.element_at("x", -1)
    first = F.get("x", F.lit(0))
    return g.select(part, first["i"].alias("first_idx"), last["i"].alias("last_idx"), first["a"].alias("seg_start"), last["b"].alias("seg_end"), F.concat(first["s"], F.array_join(tail, "")).alias("sequence"))


def _with_breaks(kept: DataFrame, part: str, idx: str, seq: str, overlap: int) -> DataFrame:
    """kept with break_ 1 where a piece does not go on from the one before; an error where that one has less than two overlaps' letters."""
    before = kept.select(F.col(part).alias("of_"), (F.col(idx) + 1).alias("after_"), F.right(F.col(seq), F.lit(overlap)).alias("tail_"), F.length(seq).alias("size_"))
    rows = kept.join(before, F.col(part).eqNullSafe(F.col("of_")) & (F.col(idx) == F.col("after_")), "left")
    short = F.raise_error(F.concat(F.lit("a piece shorter than two overlaps at "), (F.col(idx) - 1).cast("string"))).cast("int")
    apart = F.levenshtein("tail_", F.left(F.col(seq), F.lit(overlap))) > max(1, int(overlap * 0.1))
    mark = F.when(F.col("size_") < 2 * overlap, short).when(apart, 1).otherwise(0).cast("long")
    return rows.withColumn("break_", mark).drop("of_", "after_", "tail_", "size_")


def stitch_chunks(df: DataFrame, part: str, idx: str, seq: str, overlap: int, chunk: int = 1 << 20, slice_rows: int = 1 << 20, checked: bool = False) -> DataFrame:
    """What stitch() joins, as rows (part, first_idx, chunk, sequence) of `chunk` letters each, the last of an island shorter.

    Nothing meets but the pieces of one chunk: islands are numbered and the places of their pieces summed by slices, so an
    island of any length is the work of many tasks. Chunks in their order, joined, are the island's sequence.

    With checked, an island also ends where a piece's first letters differ from the end of the piece before by more than a
    tenth of the overlap, as in stitch_checked(). Pieces that others follow then need two overlaps' letters, so that the
    sequence's end is the piece's own; a shorter one is an error.
    """
    kept = df.select(part, idx, seq).where(F.coalesce(F.length(seq), F.lit(0)) > 0)
    if checked:
        kept = _with_breaks(kept, part, idx, seq, overlap)
    runs = numbered(kept, part, [idx], "k_", slice_rows).withColumn("run_", F.struct(F.col(part).alias("p"), (F.col(idx) - F.col("k_")).alias("i"))).drop("k_")
    if checked:
        runs = offset_plan(runs, part, "break_", [idx], "breaks_", slice_rows)
        runs = runs.withColumn("run_", F.struct("run_.p", "run_.i", (F.col("breaks_") + F.col("break_")).alias("b"))).drop("breaks_", "break_")
    firsts = runs.groupBy(F.col("run_").alias("of_")).agg(F.min(idx).alias("first_idx"))
    runs = runs.join(firsts, runs["run_"].eqNullSafe(firsts["of_"])).drop("of_")
    runs = runs.withColumn("text_", F.when(F.col(idx) == F.col("first_idx"), F.col(seq)).otherwise(F.substring(seq, overlap + 1, 1 << 30))).drop(seq)
    placed = offset_plan(runs.withColumn("len_", F.length("text_").cast("long")), "run_", "len_", [idx], "place_", slice_rows).where("len_ > 0")
    first, last = F.floor(F.col("place_") / F.lit(chunk)), F.floor((F.col("place_") + F.col("len_") - 1) / F.lit(chunk))
    each = placed.withColumn("chunk", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("chunk") * chunk - F.col("place_"), F.lit(0))
    end = F.least((F.col("chunk") + 1) * chunk - F.col("place_"), F.col("len_"))
    pieces = each.select(part, "first_idx", "chunk", F.struct("place_", F.substring("text_", (begin + 1).cast("int"), (end - begin).cast("int")).alias("s")).alias("x"))
    return pieces.groupBy(part, "first_idx", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]), "").alias("sequence"))


def run_length(df: DataFrame, part: str, order: list, label: str, slice_rows: int | None = None) -> DataFrame:
    """Runs of equal labels: part, run, label, n.

    With slice_rows, larger parts are cut as in offset_plan; each slice makes its own runs, and a run that goes on in the
    next slice is put together from these.
    """
    if not slice_rows:
        w = Window.partitionBy(part).orderBy(*order)
        change = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
        marked = df.withColumn("change_", change)
        return marked.withColumn("run", F.sum("change_").over(w).cast("long")).groupBy(part, "run").agg(F.first(label).alias("label"), F.count(F.lit(1)).alias("n"))
    cut = sliced(df.select(part, *order, label), part, order[0], slice_rows)
    w = Window.partitionBy(part, "slice_").orderBy(*order)
    change = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    local = cut.withColumn("change_", change).withColumn("local_", F.sum("change_").over(w))
    local = local.groupBy(part, "slice_", "local_").agg(F.first(label).alias("label_"), F.count(F.lit(1)).alias("size_"))
    w = Window.partitionBy(part).orderBy("slice_", "local_")
    change = F.when(F.lag("label_").over(w).eqNullSafe(F.col("label_")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    joined = local.withColumn("change_", change).withColumn("run", F.sum("change_").over(w).cast("long"))
    return joined.groupBy(part, "run").agg(F.first("label_").alias("label"), F.sum("size_").alias("n"))


def top_k(df: DataFrame, part, order: list, k: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(part).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def first_wins(df: DataFrame, part, order: list) -> DataFrame:
    return top_k(df, part, order, 1, "first_").drop("first_")


def page(df: DataFrame, part, order: list, offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit of each part."""
    return top_k(df, part, order, offset + limit, "rank_").where(F.col("rank_") > offset).drop("rank_")


def contiguity(df: DataFrame, part: str, start: str, end: str, size: str | None = None, slice_rows: int | None = None) -> DataFrame:
    """Per part: gaps, overlaps and their lengths against the running largest end; unused prefix and, with size, unused tail.

    With slice_rows, larger parts are cut as in offset_plan, and the largest end of the slices before is joined on.
    """
    by = [part]
    if slice_rows:
        df = sliced(df, part, start, slice_rows)
        by = [part, "slice_"]
    w = Window.partitionBy(*by).orderBy(start, end)
    x = df.withColumn("reach_", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    if slice_rows:
        ends = df.groupBy(*by).agg(F.max(end).alias("end_"))
        before = Window.partitionBy(part).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(F.col(part).alias("part_"), F.col("slice_").alias("at_"), F.max("end_").over(before).alias("before_"))
        x = x.join(ends, x[part].eqNullSafe(ends["part_"]) & (x["slice_"] == ends["at_"]))
        x = x.withColumn("reach_", F.greatest("reach_", "before_"))
    gap = F.when(F.col(start) > F.col("reach_"), F.col(start) - F.col("reach_"))
    over = F.when(F.col(start) < F.col("reach_"), F.col("reach_") - F.col(start))
    aggs = [F.count(gap).alias("n_gaps"), F.coalesce(F.sum(gap), F.lit(0)).alias("gap_total"), F.count(over).alias("n_overlap"), F.coalesce(F.sum(over), F.lit(0)).alias("overlap_total"), F.min(start).alias("first_start"), F.max(end).alias("last_end")]
    if size:
        aggs.append((F.max(size) - F.max(end)).alias("unused_tail"))
    return x.groupBy(part).agg(*aggs)


def split_counts(n: int, train: float = 0.8, val: float = 0.1, test: float | None = None) -> tuple[int, int, int]:
    """Rows of each part: truncated shares, the rest dealt one by one to train, val, test."""
    rest = 1 - train - val if test is None else test
    shares = (train, val, rest)
    if n <= 0 or min(shares) < -1e-9 or sum(shares) > 1 + 1e-9:
        raise ValueError("no names, a negative share, or shares over 1")
    total = sum(shares)
    counts = [int(n * s / total) for s in shares]
    i = 0
    while sum(counts) < n:
        counts[i % 3] += 1
        i += 1
    if not counts[0]:
        raise ValueError("no rows for training")
    return tuple(counts)


def shuffled_split(names: list[str], seed: int = 42, **shares) -> dict[str, str]:
    """name -> part by the seeded shuffle of the sorted names; for lists of segments in the driver's memory."""
    order = sorted(names)
    random.Random(seed).shuffle(order)
    a, b, _ = split_counts(len(order), **shares)
    return {x: "train" if i < a else "val" if i < a + b else "test" for i, x in enumerate(order)}


def hash_split(df: DataFrame, key: Column, parts: tuple[tuple[str, float], ...] = (("train", 0.8), ("val", 0.1), ("test", 0.1)), name: str = "split") -> DataFrame:
    """A part for each row by the md5 of its key: the same at every size, without a global order."""
    u = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out, upto = F.lit(parts[-1][0]), 1.0
    for part, share in reversed(parts):
        upto -= share
        out = out if part == parts[-1][0] else F.when(u < upto + share, part).otherwise(out)
    return df.withColumn(name, out)
