"""Key-based joins: positional, by occurrence, semi and anti."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered


def zip_join(left: DataFrame, right: DataFrame, part: str, left_order: list, right_order: list, left_id: str, right_id: str, strict: bool = True, slice_rows: int | None = None) -> DataFrame:
    """Row k of left with row k of right in each part; with strict, a longer side or different ids raise when the rows are read.

    With slice_rows, larger parts are numbered over many tasks (ordered.numbered).
    """
    a = numbered(left, part, left_order, "k_", slice_rows)
    b = numbered(right, part, right_order, "k_", slice_rows)
    out = a.join(b, [part, "k_"], "full_outer")
    if strict:
        ok = F.when(F.col(right_id).isNull(), F.raise_error(F.lit("right side shorter"))).when(F.col(left_id).isNull(), F.raise_error(F.lit("right side longer"))).when(F.col(left_id) != F.col(right_id), F.raise_error(F.lit("ids differ"))).otherwise(True)
        out = out.where(ok)
    return out.withColumnRenamed("k_", "k")


def occurrence_join(left: DataFrame, right: DataFrame, key: str, left_order: list, right_order: list) -> DataFrame:
    """The k-th row of a key on the left with the k-th of that key on the right."""
    a = left.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*left_order)))
    b = right.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*right_order)))
    return a.join(b, [key, "k"])


def wanted(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def missing(keys: DataFrame, df: DataFrame, on: str) -> DataFrame:
    return keys.join(df.select(on), on, "left_anti")


def require_all(keys: DataFrame, df: DataFrame, on: str) -> DataFrame:
    """df, or an error when its rows are read if keys has some that df lacks."""
    n = missing(keys, df, on).agg(F.count(F.lit(1)).alias("n_"))
    return df.join(F.broadcast(n)).where(F.when(F.col("n_") > 0, F.raise_error(F.concat(F.col("n_").cast("string"), F.lit(" keys are missing")))).otherwise(True)).drop("n_")


def first_present(df: DataFrame, keys: DataFrame, key: str, order: str) -> DataFrame:
    """Of each wanted key the row that is first by order, then by its other columns; one partial aggregate, no sort of a key's rows."""
    rest = [c for c in df.columns if c not in (key, order)]
    rows = wanted(df, keys, key).groupBy(key).agg(F.min(F.struct(order, *rest)).alias("r_"))
    return rows.select(key, "r_.*").select(*df.columns)


def fan_out(reads: DataFrame, places: DataFrame, key: str, order: str) -> DataFrame:
    """Each read at all places that name it: of several rows of a read the first by order counts, so no place is given twice."""
    return places.join(first_present(reads, places, key, order), key)


def mapped(df: DataFrame, values: DataFrame, key: str, what: str = "value") -> DataFrame:
    """df with the columns of values, which has a key once; a row of df whose key has none is an error that names it."""
    rows = df.join(values.withColumn("there_", F.lit(True)), key, "left")
    missing_ = F.raise_error(F.concat(F.lit(f"no {what} for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return rows.where(F.when(F.col("there_"), True).otherwise(missing_)).drop("there_")


def allowed(df: DataFrame, names: list, column: str) -> DataFrame:
    """Rows whose column is in names; a name that no row has is an error when rows are read. names: a list of the caller's."""
    asked = df.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(names)], f"{column} {dict(df.dtypes)[column]}")
    return require_all(asked, df.where(F.col(column).isin(*names)), column)
