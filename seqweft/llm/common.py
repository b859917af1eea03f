"""Helpers that several operators share: tables in the shared folder, row keys, whole groups from sorted batches."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in every operator: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session on this machine alone (tests) gets a folder of its own; on a cluster that is an error,
    as executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="seqweft-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def stash(df: DataFrame, label: str = "table") -> DataFrame:
    """Writes a table in the shared folder and reads it back, which cuts lineage; it goes by discard() or when the session ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    system, path = _path(spark, at)
    system.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out.stashed_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stash() that nothing reads any more."""
    for t in tables:
        system, path = _path(t.sparkSession, t.stashed_at)
        system.delete(path, True)


def row_keys(docs: DataFrame, id_col: str) -> tuple[DataFrame, str, bool]:
    """docs with a unique non-null long key, its column's name, and whether the key is the id itself.

    Integer ids without nulls and repeats are their own keys. All others, of any type, get row numbers, fixed by writing
    the table once.
    """
    name = "row_key_"
    while name in docs.columns:
        name += "_"
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        times = docs.groupBy(F.col(id_col).alias("id_")).agg(F.count(F.lit(1)).alias("n_"))
        if times.where("n_ > 1 or id_ is null").limit(1).isEmpty():
            return docs.withColumn(name, F.col(id_col).cast("long")), name, True
    return stash(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name, False


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(key, doc_id, text), nulls as empty texts, and whether the key is doc_id itself; keys as in row_keys."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src, name, plain = row_keys(src, "doc_id")
    return src.select(F.col(name).alias("key"), "doc_id", "text"), plain


def whole_groups(batches, key: str, rows: int = 20_000, size: int = 32 << 20):
    """Tables of complete groups, a few thousand rows or `size` bytes each, from batches sorted by a key."""
    held: list[pa.RecordBatch] = []
    n = held_bytes = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= rows or held_bytes >= size:
            first = batch.column(batch.schema.get_field_index(key))
            last = held[-1].column(held[-1].schema.get_field_index(key))[-1]
            same = 0
            while same < len(first) and first[same] == last:
                same += 1
            if same < len(first):
                yield pa.Table.from_batches([*held, batch.slice(0, same)])
                held, n, held_bytes = [], 0, 0
                batch = batch.slice(same)
        held.append(batch)
        n += batch.num_rows
        held_bytes += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def string_array(column) -> pa.Array:
    """One contiguous string array with nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column.fill_null("") if column.null_count else column
