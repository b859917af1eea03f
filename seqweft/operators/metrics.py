"""Accuracy metrics: macro and micro, status counts, conditional counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import align
from ..functions import sequence as sq


def accuracy(df: DataFrame, matches: str, aligned: str, reference: str, distance: str, *by: str) -> DataFrame:
    """Means of per-row ratios (macro) and ratios of sums (micro); an empty denominator counts as 1.0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    m, a, r, d = (F.col(c).cast("double") for c in (matches, aligned, reference, distance))
    s = lambda c: F.sum(c)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(ratio(m, a)).alias("macro_aligned"),
        F.avg(ratio(m, r)).alias("macro_reference"),
        ratio(s(m), s(a)).alias("micro_aligned"),
        ratio(s(m), s(r)).alias("micro_reference"),
        F.avg(d).alias("mean_distance"),
        F.avg(F.when(r > 0, d / r).otherwise(0.0)).alias("mean_normalised"),
    )


def counters(df: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


#: Bins of a pass of the selection.
BINS = 4096


def _first_reaching(counts: DataFrame, part: str, order: str) -> DataFrame:
    """Of rows (part, k_, n_, ...) the one of each part, by order, where the running sum of n_ reaches k_; k_ less what stands before it."""
    upto = F.sum("n_").over(Window.partitionBy(part).orderBy(order))
    rows = counts.withColumn("upto_", upto).where((F.col("upto_") >= F.col("k_")) & (F.col("upto_") - F.col("n_") < F.col("k_")))
    return rows.withColumn("k_", F.col("k_") - (F.col("upto_") - F.col("n_"))).drop("upto_")


def lower_medians(df: DataFrame, part: str, value: str, slice_rows: int | None = None, passes: int = 2) -> DataFrame:
    """(part, median_): the lower median of each part, exact; nulls do not count, and values are finite.

    With slice_rows, parts of more rows are not gathered: a pass counts their values in BINS bins between the least and the
    largest that are left, and only the bin with the median goes on, with its own least and largest value. What the passes
    leave is counted by value. Each count is a partial aggregate, so a part's rows are the work of all tasks.
    """
    rows = df.select(F.col(part).alias("part_"), F.col(value).cast("double").alias("v_")).where("v_ is not null")
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v_)").alias("median_")
    if not slice_rows:
        return rows.groupBy("part_").agg(middle).withColumnRenamed("part_", part)
    sizes = rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
    sizes = sizes.select(F.col("part_").alias("of_"), "n_", F.ceil(F.col("n_") / 2).cast("long").alias("k_"), "lo_", "hi_")
    inside = lambda left: rows.join(left, rows["part_"].eqNullSafe(left["of_"])).where(F.col("v_").between(F.col("lo_"), F.col("hi_")))
    small = rows.join(sizes.where(F.col("n_") <= slice_rows).select("of_"), rows["part_"].eqNullSafe(F.col("of_"))).groupBy("part_").agg(middle)
    left = sizes.where(F.col("n_") > slice_rows).drop("n_")
    for _ in range(passes):
        # halves, as the difference of two finite numbers may not be one
        share = (F.col("v_") / 2 - F.col("lo_") / 2) / (F.col("hi_") / 2 - F.col("lo_") / 2)
        bin_ = F.when(F.col("hi_") / 2 > F.col("lo_") / 2, F.floor(share * BINS)).otherwise(0)
        counts = inside(left).groupBy("part_", "k_", bin_.alias("bin_")).agg(F.count(F.lit(1)).alias("n_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
        left = _first_reaching(counts, "part_", "bin_").select(F.col("part_").alias("of_"), "k_", "lo_", "hi_")
    counts = inside(left).groupBy("part_", "k_", "v_").agg(F.count(F.lit(1)).alias("n_"))
    large = _first_reaching(counts, "part_", "v_").select("part_", F.col("v_").alias("median_"))
    return small.unionByName(large).withColumnRenamed("part_", part)


def robust_scaled(df: DataFrame, part: str, value: str, name: str = "z", least: float = 1e-6, slice_rows: int | None = None) -> DataFrame:
    """df with (value - median) / median absolute deviation of its part, the deviation at least `least`; medians are the lower ones.

    With slice_rows, medians of larger parts are selected over all tasks (lower_medians).
    """
    medians = lower_medians(df, part, value, slice_rows).withColumnRenamed(part, "of_")
    x = df.join(medians, df[part].eqNullSafe(medians["of_"])).drop("of_").withColumn("away_", F.abs(F.col(value) - F.col("median_")))
    spread = lower_medians(x, part, "away_", slice_rows).select(F.col(part).alias("of_"), F.col("median_").alias("mad_"))
    x = x.join(spread, x[part].eqNullSafe(spread["of_"])).drop("of_")
    return x.withColumn(name, (F.col(value) - F.col("median_")) / F.greatest("mad_", F.lit(least))).drop("median_", "mad_", "away_")


def order_violation(df: DataFrame, part: str, order: str, time: Column, margin: float) -> DataFrame:
    """(part, violation): mean of what each step of time in a part's order falls short of the margin; parts of one row are left out."""
    gap = F.lead(time).over(Window.partitionBy(part).orderBy(order)) - time
    steps = df.select(part, gap.alias("gap_")).where("gap_ is not null")
    return steps.groupBy(part).agg(F.avg(F.greatest(margin - F.col("gap_"), F.lit(0.0))).alias("violation"))


def class_probability(df: DataFrame, key: str, scores: str, width: int, which: int = 0, sure: float = 0.95) -> DataFrame:
    """(key, mean, least, most, sure): of one class's softmax probability over a row's frames, and how many frames are above `sure`."""
    frames = df.select(key, F.explode(sq.rows_of(F.col(scores).cast("array<double>"), width)).alias("frame_"))
    p = frames.select(key, F.get(sq.softmax(F.col("frame_")), F.lit(which)).alias("p_"))
    return p.groupBy(key).agg(F.avg("p_").alias("mean"), F.min("p_").alias("least"), F.max("p_").alias("most"), F.count_if(F.col("p_") > sure).alias("sure"))


def homopolymer_accuracy(df: DataFrame, reference: str, called: str, least: int | None = 3, *by: str) -> DataFrame:
    """accuracy() of the reference places that stand in runs of at least `least`, or with None of those in the central run.

    Rows without such places are left out. Called letters count by the alignment of the whole strings.
    """
    ref = F.col(reference)
    if least is None:
        run = sq.central_run(ref)
        mask = F.transform(sq.letters(ref), lambda x, i: (i >= run["start"]) & (i < run["end"]))
    else:
        mask = sq.run_mask(sq.letters(ref), least)
    rows = df.withColumn("mask_", mask).withColumn("n_ref_", F.size(F.filter("mask_", lambda m: m)))
    rows = rows.where("n_ref_ > 0").withColumn("ops_", align.alignment_stats(reference, called)["ops"])
    rows = rows.withColumn("m_", align.masked_alignment_stats(F.col("ops_"), F.col("mask_")))
    rows = rows.select(*by, F.col("m_.matches").alias("matches_"), (F.col("m_.matches") + F.col("m_.distance")).alias("aligned_"), "n_ref_", F.col("m_.distance").alias("distance_"))
    return accuracy(rows, "matches_", "aligned_", "n_ref_", "distance_", *by)


def decode_summary(df: DataFrame, text: str, *lengths: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, the mean length of decoded texts, the mean of each column of lengths, and how many texts are empty."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean_collapsed"), *(F.avg(c).alias(f"mean_{c}") for c in lengths), F.count_if(n == 0).alias("zero_length"))


def blank_rates(df: DataFrame, labels: str, reference_length: str, blank: int = 0) -> DataFrame:
    """df with blank_rate of its frames' labels, collapsed_len and collapsed_ref_ratio; null where there are no frames or no reference."""
    x = F.col(labels)
    kept = F.size(F.filter(x, lambda v, i: (v != blank) & ((i == 0) | ~F.get(x, i - 1).eqNullSafe(v))))
    rate = F.try_divide(F.size(F.filter(x, lambda v: v == blank)).cast("double"), F.size(x).cast("double"))
    return df.withColumn("blank_rate", rate).withColumn("collapsed_len", kept).withColumn("collapsed_ref_ratio", F.try_divide(F.col("collapsed_len").cast("double"), F.col(reference_length).cast("double")))


def long_references(df: DataFrame, segment: str, length: str, threshold: int, *by: str) -> DataFrame:
    """(by, evaluated, missing, exceeding): segments with a reference, without one (null or no length), and with one longer than the threshold."""
    longest = df.groupBy(*by, segment).agg(F.max(F.when(F.col(length) > 0, F.col(length))).alias("longest_"))
    return longest.groupBy(*by).agg(F.count("longest_").alias("evaluated"), F.count_if(F.col("longest_").isNull()).alias("missing"), F.count_if(F.col("longest_") > threshold).alias("exceeding"))


def issue_totals(issues: DataFrame, split: str, segment: str) -> DataFrame:
    """(split, issues, segments): how many issues, and in how many segments."""
    return issues.groupBy(split, segment).agg(F.count(F.lit(1)).alias("n_")).groupBy(split).agg(F.sum("n_").alias("issues"), F.count(F.lit(1)).alias("segments"))


def loss_averages(df: DataFrame, epoch: str, loss: str, weight: str) -> DataFrame:
    """(epoch, n, mean, mean_weighted): of each epoch's batches the plain mean of losses and the one weighted by their sizes."""
    return df.groupBy(epoch).agg(F.count(loss).alias("n"), F.avg(loss).alias("mean"), F.try_divide(F.sum(F.col(loss) * F.col(weight)), F.sum(F.when(F.col(loss).isNotNull(), F.col(weight)))).alias("mean_weighted"))


def mean_squared_error(df: DataFrame, target: str, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(value) - F.col(target)) * (F.col(value) - F.col(target))).alias("mse"))


def collated(df: DataFrame, part: str, values: str, fill: float = 0.0) -> DataFrame:
    """df with each row's values filled up to the longest of its part, and `padding`, true where they were filled; null values are all filled."""
    size = F.coalesce(F.size(F.coalesce(F.col(values), F.array().cast("array<double>"))), F.lit(0))
    longest = df.groupBy(F.col(part).alias("of_")).agg(F.max(size).alias("longest_"))
    rows = df.join(longest, df[part].eqNullSafe(longest["of_"])).drop("of_").withColumn("size_", size)
    mask = F.transform(F.sequence(F.lit(1), F.greatest("longest_", F.lit(1))), lambda i: i > F.col("size_"))
    rows = rows.withColumn("padding", F.slice(mask, F.lit(1), F.col("longest_")))
    return rows.withColumn(values, sq.padded(F.coalesce(F.col(values), F.array().cast("array<double>")), F.col("longest_"), fill)).drop("size_", "longest_")
