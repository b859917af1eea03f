"""Records of reads and regions: which of several counts, lists by key, reference rows, pruning and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the row that is last by order, then by its other columns; one partial aggregate, no sort of a key's rows."""
    rest = [c for c in df.columns if c != key]
    at = F.struct(*(F.col(c) for c in order), *(F.col(c) for c in rest if c not in order))
    return df.groupBy(key).agg(F.max(at).alias("r_")).select(key, *(F.col(f"r_.{c}").alias(c) for c in rest)).select(*df.columns)


def multimap(df: DataFrame, key: str, order: str, value: str, name: str = "values") -> DataFrame:
    """(key, values): every value of a key in order. A key's values meet in one row."""
    one = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["v"]).alias(name))


def wanted_last(df: DataFrame, keys: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The last row of each wanted key, and the wanted keys that have none."""
    keys = keys.select(key).distinct()
    return last_wins(df.join(keys, key, "left_semi"), key, order), keys.join(df.select(key), key, "left_anti")


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    """(key, position): different keys with the place where each comes first; ordered by it, they are in first-seen order."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def read_segments(reads: DataFrame, infos: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Reads joined with what is known of them by keys: of several reads the first counts, of several infos the last."""
    cols = [c for c in reads.columns if c not in keys]
    first = reads.groupBy(*keys).agg(F.min(F.struct(order, *(c for c in cols if c != order))).alias("s_")).select(*keys, *(F.col(f"s_.{c}").alias(c) for c in cols if c != order))
    others = [c for c in infos.columns if c not in keys and c != order]
    last = infos.groupBy(*keys).agg(F.max(F.struct(order, *others)).alias("i_")).select(*keys, *(F.col(f"i_.{c}").alias(c) for c in others))
    return first.join(last, keys)


def capped_regions(regions: DataFrame, order: str, cap: int = 7000, with_reference: int = 5000) -> DataFrame:
    """The first `cap` regions by order, with rank and use_reference for the first of them. Only `cap` rows of each task meet."""
    top = regions.orderBy(order).limit(cap)
    places = top.agg(F.sort_array(F.collect_list(order)).alias("o_")).select(F.posexplode("o_").alias("rank", order))
    return top.join(places, order).withColumn("rank", F.col("rank") + 1).withColumn("use_reference", F.col("rank") <= with_reference)


def with_references(reads: DataFrame, references: DataFrame, region: str = "region") -> DataFrame:
    """reads (region, read_id, seq, qual, start, end, flag) and behind them, by `place`, a row for each reference (region, hap, seq)."""
    rows = references.select(
        region, F.concat(F.lit("REFERENCE_"), F.col(region), F.lit("_"), F.col("hap")).alias("read_id"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"),
        F.lit(0).alias("start"), F.length("seq").alias("end"), F.lit(0).alias("flag"), F.when(F.col("hap") == "hap1", 1).when(F.col("hap") == "hap2", 2).otherwise(3).alias("place"),
    )
    return reads.withColumn("place", F.lit(0)).unionByName(rows)


def moved(moves: Column) -> Column:
    return F.aggregate(moves, F.lit(0).cast("long"), lambda a, m: a + m)


def entry_rules(moves: str, seq: str, mv_off: str | None = None, mv_len: str | None = None, mv_size: str | None = None) -> dict[str, Column]:
    """What makes an entry invalid: no moves, more letters than moves, a slice outside its array."""
    total = moved(F.col(moves))
    out = {"no_moves": F.coalesce(total, F.lit(0).cast("long")) <= 0, "more_letters_than_moves": F.length(seq) > total}
    if mv_off and mv_len and mv_size:
        out["slice_oob"] = (F.col(mv_off) < 0) | (F.col(mv_len) < 0) | (F.col(mv_off) + F.col(mv_len) > F.col(mv_size))
    return out


def pruned(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break none of the rules; regions without rows go with them."""
    bad = F.lit(False)
    for r in rules.values():
        bad = bad | F.coalesce(r, F.lit(True))
    return df.where(~bad)


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, or an error that names the rule when a row that breaks it is read."""
    ok = F.lit(True)
    for code, r in rules.items():
        ok = F.when(F.coalesce(r, F.lit(True)), F.raise_error(F.lit(code)).cast("boolean")).otherwise(ok)
    return df.where(ok)


def with_features(df: DataFrame, bases: str, flag: str, use_bases: bool = True, use_flag: bool = True) -> DataFrame:
    """df with features that are switched off set to 0: each base index, the read's flag."""
    if not use_bases:
        df = df.withColumn(bases, F.transform(bases, lambda x: F.lit(0).cast("int")))
    return df if use_flag else df.withColumn(flag, F.lit(0).cast(dict(df.dtypes)[flag]))


def best_reads(df: DataFrame, region: str, quality: str, mapq: str, length: str, read_id: str, k: int, tolerance: float = 0.5) -> DataFrame:
    """The k best reads of each region: by quality, then mapq, length and id, where qualities up to the tolerance apart are ties.

    Ties do not carry over (a near b and b near c say nothing of a and c), so they are made to: qualities of a region, from
    the best down, form a chain as long as each is within the tolerance of the one before; a chain is one rank, and the
    next keys decide in it. Chains are found on a region's different qualities, and only reads of the chains that hold the
    first k go on. A null quality comes after all others.
    """
    from .ordered import top_k

    values = df.groupBy(F.col(region).alias("region_"), F.col(quality).alias("quality_")).agg(F.count(F.lit(1)).alias("n_"))
    down = Window.partitionBy("region_").orderBy(F.desc_nulls_last("quality_"))
    apart = F.coalesce(F.lag("quality_").over(down) - F.col("quality_") > tolerance, F.lit(True))
    chained = values.withColumn("apart_", apart.cast("int")).withColumn("chain_", F.sum("apart_").over(down))
    sizes = chained.groupBy("region_", "chain_").agg(F.sum("n_").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("region_").orderBy("chain_").rowsBetween(Window.unboundedPreceding, -1))
    wanted = sizes.select(F.col("region_").alias("of_"), F.col("chain_").alias("at_"), F.coalesce(before, F.lit(0)).alias("before_")).where(F.col("before_") < k)
    ranks = chained.join(wanted, F.col("region_").eqNullSafe(F.col("of_")) & (F.col("chain_") == F.col("at_"))).select("region_", "quality_", "chain_")
    rows = df.join(ranks, df[region].eqNullSafe(ranks["region_"]) & df[quality].eqNullSafe(ranks["quality_"])).drop("region_", "quality_")
    return top_k(rows, region, ["chain_", F.desc(mapq), F.desc(length), read_id], k).drop("chain_")


def truncation_rows(reads: DataFrame) -> DataFrame:
    """region_name, read_id, truncated_start, truncated_end, flag of rows of with_references(), in the order of the file: reads, then references."""
    rows = reads.select(F.col("region").alias("region_name"), "read_id", F.col("start").alias("truncated_start"), F.col("end").alias("truncated_end"), "flag", "place")
    return rows.sortWithinPartitions("region_name", "place", "read_id").drop("place")


def region_blocks(index: DataFrame) -> DataFrame:
    """(chr, region, sig_off, sig_len, mv_off, mv_len, count) of an index: where each region's signals and moves begin, how long they are, and of how many reads."""
    return index.groupBy("chr", "region").agg(
        F.min("sig_offset").alias("sig_off"), F.sum("sig_len").alias("sig_len"), F.min("mv_offset").alias("mv_off"), F.sum("mv_len").alias("mv_len"), F.count(F.lit(1)).alias("count")
    )

