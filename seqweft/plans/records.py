"""Queries over records of reads and regions, beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import align
from ..functions import sequence as sq
from ..operators import ordered, records, rules
from .queries import query, table

_LAST = "l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC"


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")


@query(f"SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_LAST}) AS k FROM lineitem) WHERE k = 1")
def last_wins(spark, d):
    return records.last_wins(_lines(spark, d), "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]).select("l_partkey", "l_orderkey", "l_linenumber")


@query(
    f"""SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_LAST}) AS k FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)) WHERE k = 1"""
)
def wanted_reads(spark, d):
    keys = table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    return records.wanted_last(_lines(spark, d), keys, "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"])[0].select("l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_reads(spark, d):
    keys = table(spark, d, "customer").select("c_custkey")
    return records.wanted_last(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), keys, "c_custkey", ["o_orderkey"])[1]


@query("SELECT o_custkey, string_agg(o_orderkey::varchar, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def multimap(spark, d):
    m = records.multimap(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderkey")
    return m.select("o_custkey", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("keys"))


@query("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def first_seen(spark, d):
    return records.first_seen(table(spark, d, "events"), "event_type", "event_id")


@query(
    """WITH s AS (SELECT l_partkey, l_orderkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY ALL),
    i AS (SELECT l_partkey, l_orderkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_orderkey ORDER BY l_linenumber DESC, l_suppkey DESC) AS k FROM lineitem) WHERE k = 1)
    SELECT l_partkey, l_orderkey, first_line, l_suppkey FROM s JOIN i USING (l_partkey, l_orderkey)"""
)
def read_segments(spark, d):
    li = table(spark, d, "lineitem")
    reads = li.select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_linenumber").alias("first_line"))
    infos = li.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    return records.read_segments(reads, infos, ["l_partkey", "l_orderkey"], "l_linenumber").select("l_partkey", "l_orderkey", "first_line", "l_suppkey")


@query(
    """SELECT o_orderkey, rank, rank <= 5000 AS use_reference FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders WHERE o_totalprice > 1000) WHERE rank <= 7000"""
)
def capped_regions(spark, d):
    """The reference's cap is the feature: the first 7000 regions, of which 5000 have references."""
    out = records.capped_regions(table(spark, d, "orders").where("o_totalprice > 1000").select("o_orderkey"), "o_orderkey")
    return out.select("o_orderkey", F.col("rank").cast("long").alias("rank"), "use_reference")


@query(
    """SELECT o_custkey AS region, o_orderkey::varchar AS read_id, length(o_orderpriority) AS "end", 0 AS place FROM orders
    UNION ALL SELECT c_custkey, 'REFERENCE_' || c_custkey || '_' || hap, length(c_name), CASE hap WHEN 'hap1' THEN 1 ELSE 2 END FROM customer, (VALUES ('hap1'), ('hap2')) h(hap)"""
)
def with_references(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("region"), F.col("o_orderkey").cast("string").alias("read_id"), F.col("o_orderpriority").alias("seq"), F.col("o_orderpriority").alias("qual"),
        F.lit(0).alias("start"), F.length("o_orderpriority").alias("end"), F.lit(0).alias("flag"),
    )
    refs = table(spark, d, "customer").select(F.col("c_custkey").alias("region"), F.explode(F.array(F.lit("hap1"), F.lit("hap2"))).alias("hap"), F.col("c_name").alias("seq"))
    return records.with_references(o, refs).select("region", "read_id", F.col("end").cast("long").alias("end"), "place")


_ENTRIES = "SELECT vec_id, label, list_transform(embedding::double[], lambda x: CASE WHEN x > 0.1 THEN 1 ELSE 0 END) AS moves FROM embeddings"


def _entries(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.when(x.cast("double") > 0.1, 1).otherwise(0)).alias("moves"))
    return e.withColumn("seq", F.repeat(F.lit("A"), (F.col("vec_id") % 25).cast("int")))


@query(f"SELECT vec_id, label FROM ({_ENTRIES}) WHERE list_sum(moves) > 0 AND vec_id % 25 <= list_sum(moves)")
def pruned_entries(spark, d):
    return records.pruned(_entries(spark, d), records.entry_rules("moves", "seq")).select("vec_id", "label")


@query(
    f"""SELECT vec_id, code FROM (SELECT vec_id, unnest(list_filter([CASE WHEN list_sum(moves) <= 0 THEN 'no_moves' END, CASE WHEN vec_id % 25 > list_sum(moves) THEN 'more_letters_than_moves' END],
    lambda c: c IS NOT NULL)) AS code FROM ({_ENTRIES}))"""
)
def entry_violations(spark, d):
    return rules.issues(_entries(spark, d), records.entry_rules("moves", "seq"), "vec_id")


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY floor(l_quantity / 0.5::double) DESC, l_linenumber DESC, l_extendedprice DESC, l_orderkey) AS k FROM lineitem) WHERE k <= 10"""
)
def best_reads(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_linenumber", "l_extendedprice", "l_orderkey")
    return records.best_reads(li, "l_suppkey", "l_quantity", "l_linenumber", "l_extendedprice", "l_orderkey", 10).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    """WITH v AS (SELECT DISTINCT l_suppkey, l_extendedprice / 100 AS q FROM lineitem),
    a AS (SELECT *, CASE WHEN lag(q) OVER w - q <= 2.5 THEN 0 ELSE 1 END AS apart FROM v WINDOW w AS (PARTITION BY l_suppkey ORDER BY q DESC)),
    c AS (SELECT l_suppkey, q, sum(apart) OVER (PARTITION BY l_suppkey ORDER BY q DESC ROWS UNBOUNDED PRECEDING) AS chain FROM a),
    r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_suppkey, row_number() OVER (PARTITION BY l.l_suppkey ORDER BY chain, l_linenumber DESC, l_quantity DESC, l_orderkey) AS k
      FROM lineitem l JOIN c USING (l_suppkey) WHERE c.q = l_extendedprice / 100)
    SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM r WHERE k <= 10"""
)
def best_reads_near(spark, d):
    """Prices up to 2.50 hundreds apart are ties, in chains."""
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 100).alias("q"), "l_linenumber", "l_quantity", "l_orderkey")
    return records.best_reads(li, "l_suppkey", "q", "l_linenumber", "l_quantity", "l_orderkey", 10, 2.5).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query(
    """SELECT l_returnflag AS chr, l_partkey AS region, min(l_orderkey) AS sig_off, sum(l_quantity * 6)::bigint AS sig_len, min(l_orderkey) AS mv_off, sum(l_quantity)::bigint AS mv_len, count(*) AS count
    FROM lineitem GROUP BY l_returnflag, l_partkey"""
)
def region_blocks(spark, d):
    q = F.col("l_quantity").cast("long")
    i = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("chr"), F.col("l_partkey").alias("region"), F.col("l_orderkey").alias("sig_offset"), (q * 6).alias("sig_len"), F.col("l_orderkey").alias("mv_offset"), q.alias("mv_len"))
    return records.region_blocks(i)


@query(
    """WITH s AS (SELECT user_id, floor(epoch_us(ts) / 1e6)::bigint % 100000 AS a, floor(value * 60)::bigint AS n FROM events),
    k AS (SELECT user_id, a, a + n AS b FROM s WHERE user_id NOT IN (SELECT user_id FROM s WHERE n < 0 OR a + n > 130000)),
    r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
    t AS (SELECT user_id, min(a) AS p, coalesce(sum(a - reach) FILTER (a > reach), 0) AS g, coalesce(sum(reach - a) FILTER (a < reach), 0) AS o, 130000 - max(b) AS u FROM r GROUP BY user_id)
    SELECT user_id, code, n::bigint AS n FROM (SELECT user_id, unnest(['mv_unused_prefix', 'mv_gap', 'mv_overlap', 'mv_unused_tail']) AS code, unnest([p, g, o, u]) AS n FROM t) WHERE n > 0"""
)
def range_issues(spark, d):
    a = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("long") % 100000
    e = table(spark, d, "events").select("user_id", a.alias("a"), F.floor(F.col("value") * 60).cast("long").alias("n"), F.lit(130000).cast("long").alias("size"))
    return rules.range_issues(e, "user_id", "a", "n", "size", "mv")


@query(
    """SELECT doc_id, kind || '_load_error' AS code FROM documents, (VALUES ('labels'), ('embeddings')) k(kind)
    WHERE NOT (kind = 'labels' AND doc_id IN (SELECT doc_id FROM labels)) AND NOT (kind = 'embeddings' AND doc_id IN (SELECT vec_id FROM embeddings))"""
)
def load_issues(spark, d):
    found = table(spark, d, "labels").select("doc_id", F.lit("labels").alias("kind")).union(table(spark, d, "embeddings").select("vec_id", F.lit("embeddings")))
    return rules.load_issues(table(spark, d, "documents").select("doc_id"), found, "doc_id", ("labels", "embeddings"))


@query(
    """WITH x AS (SELECT vec_id, embedding::double[] AS e FROM embeddings)
    SELECT vec_id, code FROM (SELECT vec_id, unnest(list_filter([CASE WHEN len(list_filter(e, lambda v: v > 0.3)) > 0 THEN 'signal_posinf' END, CASE WHEN len(list_filter(e, lambda v: v < -0.3)) > 0 THEN 'signal_neginf' END], lambda c: c IS NOT NULL)) AS code FROM x)"""
)
def health_issues(spark, d):
    """Values beyond 0.3 stand for infinities."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(v > 0.3, float("inf")).when(v < -0.3, float("-inf")).otherwise(v))
    return rules.issues(table(spark, d, "embeddings").select("vec_id", x.alias("x")), rules.health_rules(F.col("x"), "signal"), "vec_id")


@query(
    """SELECT event_id, coalesce(sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start
    FROM (SELECT event_id, event_type, floor(value)::bigint AS value FROM events)"""
)
def offset_plan_hot(spark, d):
    """A handful of keys, each cut over many tasks."""
    e = table(spark, d, "events").select("event_type", "event_id", F.floor("value").cast("long").alias("value"))
    return ordered.offset_plan(e, "event_type", "value", ["event_id"], "start", slice_rows=500).select("event_id", "start")


@query(
    """WITH c AS (SELECT *, CASE WHEN lag(user_id % 2) OVER w IS NOT DISTINCT FROM user_id % 2 AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)::bigint AS run FROM c)
    SELECT event_type, run, any_value(user_id % 2) AS label, count(*) AS n FROM r GROUP BY event_type, run"""
)
def run_length_hot(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", (F.col("user_id") % 2).alias("odd"))
    return ordered.run_length(e, "event_type", ["event_id"], "odd", slice_rows=500)


@query(
    """WITH s AS (SELECT event_type, event_id * 10 AS a, event_id * 10 + floor(value)::bigint AS b FROM events),
    r AS (SELECT *, max(b) OVER (PARTITION BY event_type ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
    SELECT event_type, count(*) FILTER (a > reach) AS n_gaps, coalesce(sum(a - reach) FILTER (a > reach), 0)::bigint AS gap_total, count(*) FILTER (a < reach) AS n_overlap,
    coalesce(sum(reach - a) FILTER (a < reach), 0)::bigint AS overlap_total, min(a) AS first_start, max(b) AS last_end FROM r GROUP BY event_type"""
)
def contiguity_hot(spark, d):
    a = F.col("event_id") * 10
    e = table(spark, d, "events").select("event_type", a.alias("a"), (a + F.floor("value").cast("long")).alias("b"))
    return ordered.contiguity(e, "event_type", "a", "b", slice_rows=500)


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'unmapped' WHEN l_quantity >= 20 THEN 'kept' ELSE 'low' END AS state FROM lineitem WHERE (l_partkey % 4096 & 2308) = 0"""
)
def primary_reads(spark, d):
    """Flags from part keys; primary records only, parted by their quality."""
    li = table(spark, d, "lineitem").where(sq.is_primary((F.col("l_partkey") % 4096).cast("int")))
    state = F.when(F.col("l_linenumber") == 1, "unmapped").when(sq.mapped_well(F.col("l_quantity")), "kept").otherwise("low")
    return li.select("l_orderkey", "l_linenumber", state.alias("state"))


@query(
    """SELECT p_partkey, CASE p_size % 9 WHEN 3 THEN 3 WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 0 WHEN 8 THEN 0 ELSE 4 END::bigint AS errors FROM part"""
)
def window_errors(spark, d):
    """Errors of the ops 2M2I2D3M from a place on: the insertion has 2 letters, the deletion 2."""
    c = sq.parse_cigar(F.lit("2M2I2D3M"))
    s = F.col("p_size") % 9
    return table(spark, d, "part").select("p_partkey", align.errors_in_window(c, s, s + 9).alias("errors"))
