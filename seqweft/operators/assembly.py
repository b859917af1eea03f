"""Assembly graphs, and stitching that checks overlaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.align import align


def stitch_checked(df: DataFrame, part: str, idx: str, seq: str, overlap: int) -> DataFrame:
    """(part, first_idx, last_idx, sequence, bad_breaks): as stitch, but a segment also ends where the overlap differs by more than a tenth."""
    kind = dict(df.dtypes)[part]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, text, first, last, bad = [], None, None, None, 0
        for i, s in sorted(zip(pdf[idx], pdf[seq].fillna(""), strict=True)):
            apart = last is None or i != last + 1
            if text is not None and s and not apart and align(text[-overlap:], s[:overlap])[0] > max(1, int(overlap * 0.1)):
                apart, bad = True, bad + 1
            if text is not None and (apart or not s):
                out.append((pdf[part].iloc[0], first, last, text))
                text = None
            if s:
                text, first = (s, i) if text is None else (text + s[overlap:], first)
            last = i
        if text is not None:
            out.append((pdf[part].iloc[0], first, last, text))
        ends = pd.DataFrame(out, columns=[part, "first_idx", "last_idx", "sequence"])
        return ends.assign(bad_breaks=bad)

    return df.select(part, idx, seq).groupBy(part).applyInPandas(fold, f"{part} {kind}, first_idx long, last_idx long, sequence string, bad_breaks long")


def gfa_nodes(lines: DataFrame, value: str = "value") -> DataFrame:
    f = F.split(value, "\t")
    return lines.where(F.startswith(value, F.lit("S\t"))).select(f[1].alias("node"), f[2].alias("seq"))


def gfa_edges(lines: DataFrame, value: str = "value") -> DataFrame:
    f = F.split(value, "\t")
    return lines.where(F.startswith(value, F.lit("L\t"))).select(f[1].alias("source"), f[2].alias("source_strand"), f[3].alias("target"), f[4].alias("target_strand"))


def reference_coverage(nodes: DataFrame, reference: str) -> DataFrame:
    """(nodes, matching, coverage): nodes that stand in a reference string, their letters over its length; it can pass 1."""
    at = F.instr(F.lit(reference), F.col("seq"))
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(at > 0).alias("matching"), (F.coalesce(F.sum(F.when(at > 0, F.length("seq"))), F.lit(0)) / len(reference)).alias("coverage"))


def node_places(nodes: DataFrame, references: DataFrame, region: str = "region") -> DataFrame:
    """(region, node, hap, place): where each node's letters first stand in each reference of its region, 1-based; others are left out."""
    r = references.select(region, "hap", F.col("seq").alias("reference_"))
    return nodes.join(r, region).withColumn("place", F.instr("reference_", F.col("seq"))).where("place > 0").select(region, "node", "hap", "place")


def gfa_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): S lines of nodes (node, seq) and L lines of edges (source, source_strand, target, target_strand), behind them."""
    s = nodes.select(F.concat_ws("\t", F.lit("S"), "node", "seq").alias("value"))
    return s.union(edges.select(F.concat_ws("\t", F.lit("L"), "source", "source_strand", "target", "target_strand", F.lit("0M")).alias("value")))


def json_lines(df: DataFrame, *by: str) -> DataFrame:
    """(by, value): each row as one JSON object, nulls included, beside the columns that name its file."""
    return df.select(*by, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
