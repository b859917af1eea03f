"""Exact dedup: groups by a 128-bit digest of the normalised text, compares bytes inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, row_keys, stash


def normalised(text: Column) -> Column:
    """White-space runs as one space; null as the empty text."""
    return F.coalesce(F.regexp_replace(text, f"{SPACE}+", " "), F.lit(""))


def text_groups(rows: DataFrame, digest=F.md5) -> DataFrame:
    """rows (t, doc_id, ...) put together by (digest, bytes): h, t, keep_id, group_size."""
    return rows.groupBy(digest(F.col("t")).alias("h"), "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=F.md5, confirm=lambda t: F.sha2(t, 256)) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are first put together by (digest, bytes): the partial aggregate removes copies before the shuffle, so a text
    that a third of all rows share travels once per map task, and equality is that of bytes, never of digests. The
    resulting groups are narrow, are written once, and are joined to the rows by (digest, sha256); groups whose digests
    both collide with another text's are joined by the text itself. Both sides of that join are plain scans, so
    adaptive execution splits a hot key.

    Null texts count as empty. A null id never stays if its group has another id; a group with null ids alone keeps
    all of them under a null keep_id. Repeated rows with the id that stays are all kept. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    groups = text_groups(rows, digest).select("h", confirm(F.col("t")).alias("text_sha256"), "keep_id", "group_size", F.col("t"))
    narrow = stash(groups.drop("t"), "exact")
    clashing = narrow.groupBy("h", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keys = rows.select("doc_id", digest(F.col("t")).alias("h"), confirm(F.col("t")).alias("text_sha256"))
    if clashing.isEmpty():
        out = keys.join(narrow, ["h", "text_sha256"])
    else:
        texts = stash(groups, "exact-texts")
        out = rows.join(texts, "t").select("doc_id", "keep_id", "group_size", "text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=F.md5) -> DataFrame:
    """One row of each group of equal texts, with all its columns: the one with the smallest id.

    Null texts count as empty. Ids of any type; a null id comes after all others, and rows that share an id or have
    none come in the order in which they were first read, so exactly one row of each group stays. The groups' keys are
    all that is joined back to the rows.
    """
    rows, name, plain = row_keys(docs, id_col)
    who = F.col(name) if plain else F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(name).alias("key"))
    groups = text_groups(rows.select(who.alias("doc_id"), normalised(F.col(text_col)).alias("t")), digest)
    keep = groups.select((F.col("keep_id") if plain else F.col("keep_id.key")).alias(name))
    return rows.join(keep, name, "left_semi").select(*docs.columns)
