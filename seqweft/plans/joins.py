"""Queries of key-based joins, collation, splits and graph text, beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import assembly, keyed, metrics, ordered
from ..session import scratch
from ..sources import formats
from .queries import _READS, query, reads_of, table


@query("SELECT user_id, min_by(event_id, (event_id, value)) AS event_id, min_by(value, (event_id, value)) AS value FROM events WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY user_id")
def first_present(spark, d):
    """The first event of each user who is a customer too."""
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return keyed.first_present(table(spark, d, "events").select("user_id", "event_id", "value"), keys, "user_id", "event_id")


@query("SELECT o_orderkey, o_custkey AS user_id, event_id FROM orders JOIN (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id) ON o_custkey = user_id")
def fan_out(spark, d):
    """Each user's first event at all of the user's orders."""
    places = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return keyed.fan_out(table(spark, d, "events").select("user_id", "event_id"), places, "user_id", "event_id").select("o_orderkey", "user_id", "event_id")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def reference_map(spark, d):
    """Customers with their nation's name; a nation that is missing would be an error."""
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    return keyed.mapped(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("key")), names, "key", "nation").select("c_custkey", "n_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def allow_list(spark, d):
    return keyed.allowed(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["F", "O", "F"], "o_orderstatus")


@query(
    f"""WITH g AS (SELECT o_orderkey AS region, o_custkey AS chrom, o_orderkey * 53 % 2500 AS a, o_orderkey * 53 % 2500 + o_orderkey % 900 AS b FROM orders)
    SELECT region, read_id, rend - rstart >= greatest(ceil((b - a) * 0.9::double), 1) AS enough FROM g JOIN ({_READS}) r ON g.chrom = r.chrom AND (rstart + region) % 5 = 0"""
)
def region_lengths(spark, d):
    """Whether reads are long enough for regions of their chromosome."""
    o = table(spark, d, "orders")
    g = o.select(F.col("o_orderkey").alias("region"), F.col("o_custkey").alias("chrom"), (F.col("o_orderkey") * 53 % 2500).alias("a")).withColumn("b", F.col("a") + F.col("region") % 900)
    pairs = g.join(reads_of(spark, d), "chrom").where((F.col("rstart") + F.col("region")) % 5 == 0)
    return pairs.select("region", "read_id", sq.long_enough_region(F.col("rend") - F.col("rstart"), F.col("a"), F.col("b")).alias("enough"))


@query(
    """WITH x AS (SELECT vec_id, label, list_filter(embedding::double[], lambda x: x > 0) AS v FROM embeddings),
    m AS (SELECT label, max(len(v)) AS longest FROM x GROUP BY label)
    SELECT vec_id, longest AS size, longest - len(v) AS filled, round(coalesce(list_sum(v), 0), 9) AS total FROM x JOIN m ON x.label IS NOT DISTINCT FROM m.label"""
)
def collated(spark, d):
    """Values of a label's rows filled up to its longest."""
    x = table(spark, d, "embeddings").select("vec_id", "label", F.filter(F.col("embedding").cast("array<double>"), lambda x: x > 0).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b)
    c = metrics.collated(x, "label", "v")
    return c.select("vec_id", F.size("v").cast("long").alias("size"), F.size(F.filter("padding", lambda p: p)).cast("long").alias("filled"), F.round(total, 9).alias("total"))


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint / 4294967296::double < 0.75 THEN 'train' ELSE 'val' END AS split FROM documents")
def two_way_split(spark, d):
    return ordered.hash_split(table(spark, d, "documents").select("doc_id"), F.col("doc_id"), (("train", 0.75), ("val", 0.25)))


@query(
    """WITH n AS (SELECT upper(substr(p_name, 1, 2)) AS seq FROM part), r AS (SELECT string_agg(upper(n_name), '' ORDER BY n_nationkey) AS r FROM nation)
    SELECT (SELECT count(*) FROM part WHERE p_size > 25) AS edges, count(*) AS nodes, count(*) FILTER (strpos(r, seq) > 0) AS matching,
      round(coalesce(sum(length(seq)) FILTER (strpos(r, seq) > 0), 0) / length(any_value(r))::double, 9) AS coverage FROM n, r"""
)
def assembly_graph(spark, d):
    """Nodes and edges as graph text and back; nodes that stand in the nations' names."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("node"), F.upper(F.substring("p_name", 1, 2)).alias("seq"), "p_size")
    edges = p.where("p_size > 25").select(F.col("node").alias("source"), F.lit("+").alias("source_strand"), F.col("node").alias("target"), F.lit("-").alias("target_strand"))
    path = scratch(spark, "gfa")
    formats.write_lines(assembly.gfa_lines(p.select("node", "seq"), edges), path)
    lines = spark.read.text(path)
    names = table(spark, d, "nation").orderBy("n_nationkey").select(F.upper("n_name").alias("n")).collect()  # 25 rows at any size
    counts = assembly.reference_coverage(assembly.gfa_nodes(lines), "".join(r.n for r in names))
    n = assembly.gfa_edges(lines).where("source_strand = '+' and target_strand = '-'").agg(F.count(F.lit(1)).alias("edges"))
    both = counts.unionByName(n, allowMissingColumns=True)
    return both.agg(F.max("edges").alias("edges"), F.max("nodes").alias("nodes"), F.max("matching").alias("matching"), F.round(F.max("coverage"), 9).alias("coverage"))


@query("SELECT o_orderstatus AS region, count(*) AS n, sum(o_orderkey)::bigint AS keys, count(*) FILTER (o_custkey % 2 = 0) AS known FROM orders GROUP BY o_orderstatus")
def region_json(spark, d):
    """A JSON file for each region, nulls included, read back by region."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("region"), "o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("cust"))
    path = scratch(spark, "json")
    formats.write_lines(assembly.json_lines(o, "region").select(F.col("region").alias("of"), "value"), path, "of")
    read = spark.read.schema("region string, o_orderkey long, cust long, of string").json(path)
    return read.where("region = of").groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.count("cust").alias("known"))
