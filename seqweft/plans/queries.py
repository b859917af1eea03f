"""The library's queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import align, decode
from ..functions import sequence as sq
from ..operators import intervals, keyed, metrics, ordered, partial_order, rules, tiling

WINDOW, OVERLAP = 1000, 50
STEP = WINDOW - OVERLAP
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def windows_of(spark, d):
    return tiling.tile_windows(table(spark, d, "documents"), "doc_id", "n_chars", WINDOW, OVERLAP)


_WINDOWS = f"""SELECT doc_id AS chrom, i AS idx, i * {STEP} + 1 AS ws, least(i * {STEP} + {WINDOW}, n_chars) AS we
  FROM (SELECT doc_id, n_chars, unnest(range(CASE WHEN n_chars <= 0 THEN 0 WHEN n_chars <= {WINDOW} THEN 1
        ELSE ceil((n_chars - {WINDOW}) / {STEP}.0::double)::bigint + 1 END)) AS i FROM documents)"""


@query(f"SELECT chrom, idx::int AS idx, ws, we FROM ({_WINDOWS})")
def tile_windows(spark, d):
    return windows_of(spark, d)


def reads_of(spark, d):
    """Intervals from lineitem: chromosome, 1-based closed span, an id."""
    li = table(spark, d, "lineitem")
    start = F.col("l_suppkey") * 37 % 3000 + 1
    return li.select(F.col("l_partkey").alias("chrom"), start.alias("rstart"), (start + (F.col("l_quantity") * 40).cast("long") + 400).alias("rend"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("read_id"))


_READS = """SELECT l_partkey AS chrom, l_suppkey * 37 % 3000 + 1 AS rstart, l_suppkey * 37 % 3000 + 1 + (l_quantity * 40)::bigint + 400 AS rend,
  l_orderkey || '_' || l_linenumber AS read_id FROM lineitem"""


@query(f"SELECT w.chrom, w.idx::int AS idx, ws, we, rstart, rend, read_id FROM ({_WINDOWS}) w JOIN ({_READS}) r ON w.chrom = r.chrom AND rstart <= ws AND rend >= we")
def window_containment(spark, d):
    return intervals.reads_over_windows(reads_of(spark, d), windows_of(spark, d), STEP).select("chrom", "idx", "ws", "we", "rstart", "rend", "read_id")


@query(
    f"""WITH m AS (SELECT w.chrom, w.idx, ws, we, rend - rstart + 1 AS len FROM ({_WINDOWS}) w JOIN ({_READS}) r ON w.chrom = r.chrom AND rstart <= ws AND rend >= we),
    c AS (SELECT chrom, idx, ws, we, count(*) AS n, min(len) AS shortest, max(len) AS longest FROM m WHERE len >= greatest(ceil((we - ws + 1) * 0.9::double), 1) GROUP BY ALL),
    i AS (SELECT *, idx - row_number() OVER (PARTITION BY chrom ORDER BY idx) AS island FROM c)
    SELECT chrom, min(idx)::int AS first_idx, max(idx)::int AS last_idx, min(ws) AS seg_start, max(we) AS seg_end, sum(n)::bigint AS n_reads, min(shortest) AS shortest, max(longest) AS longest
    FROM i GROUP BY chrom, island"""
)
def covered_segments(spark, d):
    """Windows, the reads that contain them, those long enough, counts, islands: the flagship of §7.5."""
    m = intervals.reads_over_windows(reads_of(spark, d), windows_of(spark, d), STEP)
    length = F.col("rend") - F.col("rstart") + 1
    c = m.where(sq.long_enough(length, F.col("we") - F.col("ws") + 1)).groupBy("chrom", "idx", "ws", "we").agg(F.count(F.lit(1)).alias("n"), F.min(length).alias("shortest"), F.max(length).alias("longest"))
    i = c.withColumn("island", F.col("idx") - F.row_number().over(Window.partitionBy("chrom").orderBy("idx")))
    return i.groupBy("chrom", "island").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min("ws").alias("seg_start"), F.max("we").alias("seg_end"), F.sum("n").alias("n_reads"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest")).drop("island")


@query(
    f"""WITH g AS (SELECT o_orderkey AS region, o_custkey AS chrom, o_orderkey * 53 % 2500 AS a, o_orderkey * 53 % 2500 + 300 AS b FROM orders)
    SELECT region, g.chrom, a, b, rstart, rend, read_id FROM g JOIN ({_READS}) r ON g.chrom = r.chrom AND rstart <= a + 1 AND rend >= b"""
)
def region_reads(spark, d):
    """Reads that contain regions, one base loose on the left."""
    g = table(spark, d, "orders").select(F.col("o_orderkey").alias("region"), F.col("o_custkey").alias("chrom"), (F.col("o_orderkey") * 53 % 2500).alias("a")).withColumn("b", F.col("a") + 300)
    return intervals.containing(reads_of(spark, d), g, "chrom", ("rstart", "rend"), ("a", "b"), 1).select("region", "chrom", "a", "b", "rstart", "rend", "read_id")


@query(f"SELECT chrom, idx::int AS idx, ws, we, pos FROM ({_WINDOWS}) w JOIN (SELECT o_custkey AS c, o_orderkey * 31 % 3000 + 1 AS pos FROM orders) v ON w.chrom = v.c AND pos BETWEEN ws AND we")
def window_variants(spark, d):
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("chrom"), (F.col("o_orderkey") * 31 % 3000 + 1).alias("pos"))
    return intervals.points_in(windows_of(spark, d), v, "chrom", ("ws", "we"), "pos").select("chrom", "idx", "ws", "we", "pos")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lineitem"""
)
def offset_plan(spark, d):
    return ordered.offset_plan(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey"], "start").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "start")


@query(
    f"""WITH w AS (SELECT w.*, CASE WHEN (w.chrom + idx) % 7 = 3 THEN '' ELSE substr(text, ws, we - ws + 1) END AS s FROM ({_WINDOWS}) w JOIN documents ON chrom = doc_id),
    i AS (SELECT *, idx - row_number() OVER (PARTITION BY chrom ORDER BY idx) AS island FROM w WHERE s <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY chrom, island ORDER BY idx) AS k FROM i)
    SELECT chrom, min(idx)::int AS first_idx, max(idx)::int AS last_idx, min(ws) AS seg_start, max(we) AS seg_end,
      sha256(string_agg(CASE WHEN k = 1 THEN s ELSE substr(s, {OVERLAP + 1}) END, '' ORDER BY idx)) AS digest FROM r GROUP BY chrom, island"""
)
def stitch_islands(spark, d):
    w = windows_of(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("chrom"), "text"), "chrom")
    s = F.when((F.col("chrom") + F.col("idx")) % 7 == 3, "").otherwise(F.substring("text", F.col("ws").cast("int"), (F.col("we") - F.col("ws") + 1).cast("int")))
    out = ordered.stitch(w.withColumn("s", s), "chrom", "idx", "s", OVERLAP, "ws", "we")
    return out.withColumn("digest", F.sha2("sequence", 256)).drop("sequence")


@query(
    f"""WITH w AS (SELECT w.*, CASE WHEN (w.chrom + idx) % 7 = 3 THEN '' ELSE substr(text, ws, we - ws + 1) END AS s FROM ({_WINDOWS}) w JOIN documents ON chrom = doc_id),
    i AS (SELECT *, idx - row_number() OVER (PARTITION BY chrom ORDER BY idx) AS island FROM w WHERE s <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY chrom, island ORDER BY idx) AS k FROM i),
    t AS (SELECT chrom, min(idx)::int AS first_idx, string_agg(CASE WHEN k = 1 THEN s ELSE substr(s, {OVERLAP + 1}) END, '' ORDER BY idx) AS t FROM r GROUP BY chrom, island),
    c AS (SELECT chrom, first_idx, t, unnest(range((length(t) - 1) // 700 + 1))::bigint AS chunk FROM t)
    SELECT chrom, first_idx, chunk, sha256(substr(t, chunk * 700 + 1, 700)) AS digest FROM c"""
)
def stitch_chunks(spark, d):
    """Islands as ordered chunks of 700 letters; parts of over 8 windows are cut in slices."""
    w = windows_of(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("chrom"), "text"), "chrom")
    s = F.when((F.col("chrom") + F.col("idx")) % 7 == 3, "").otherwise(F.substring("text", F.col("ws").cast("int"), (F.col("we") - F.col("ws") + 1).cast("int")))
    out = ordered.stitch_chunks(w.withColumn("s", s), "chrom", "idx", "s", OVERLAP, 700, 8)
    return out.withColumn("digest", F.sha2("sequence", 256)).drop("sequence")


@query(
    """WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::bigint AS run FROM c)
    SELECT user_id, run, any_value(event_type) AS label, count(*) AS n FROM r GROUP BY user_id, run"""
)
def run_length(spark, d):
    return ordered.run_length(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT * FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def topk_per_group(spark, d):
    return ordered.top_k(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", [F.desc("value"), "event_id"], 5)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k BETWEEN 4 AND 9")
def page_per_group(spark, d):
    return ordered.page(table(spark, d, "events"), "user_id", ["ts", "event_id"], 3, 6).select("user_id", "event_id")


@query(
    """SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1"""
)
def first_wins(spark, d):
    return ordered.first_wins(table(spark, d, "lineitem"), "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]).select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    """WITH s AS (SELECT user_id, floor(epoch_us(ts) / 1e6)::bigint AS a, floor(epoch_us(ts) / 1e6)::bigint + floor(value * 60)::bigint AS b FROM events),
    r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
    SELECT user_id, count(*) FILTER (a > reach) AS n_gaps, coalesce(sum(a - reach) FILTER (a > reach), 0)::bigint AS gap_total, count(*) FILTER (a < reach) AS n_overlap,
    coalesce(sum(reach - a) FILTER (a < reach), 0)::bigint AS overlap_total, min(a) AS first_start, max(b) AS last_end FROM r GROUP BY user_id"""
)
def contiguity_gaps(spark, d):
    a = F.floor(seconds("ts") / F.lit(1e6)).cast("long")
    e = table(spark, d, "events").select("user_id", a.alias("a"), (a + F.floor(F.col("value") * 60).cast("long")).alias("b"))
    return ordered.contiguity(e, "user_id", "a", "b")


_DQ = """SELECT l_orderkey, l_linenumber, l_quantity::bigint AS mv_len, (l_quantity * 6)::bigint + CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS sig_len,
  l_suppkey % 90 - 2 AS mv_off, l_suppkey % 700 - 2 AS sig_off FROM lineitem"""


@query(
    f"""WITH x AS ({_DQ})
    SELECT l_orderkey, l_linenumber, code FROM (
      SELECT *, unnest(list_filter([CASE WHEN mv_len * 6 <> sig_len THEN 'stride_mismatch' END, CASE WHEN mv_off < 0 THEN 'mv_offset_negative' END, CASE WHEN mv_len < 0 THEN 'mv_len_negative' END,
        CASE WHEN mv_off >= 0 AND mv_len >= 0 AND mv_off + mv_len > 100 THEN 'mv_slice_oob' END, CASE WHEN sig_off < 0 THEN 'signal_offset_negative' END, CASE WHEN sig_len < 0 THEN 'signal_length_negative' END,
        CASE WHEN sig_off >= 0 AND sig_len >= 0 AND sig_off + sig_len > 800 THEN 'signal_slice_oob' END], lambda c: c IS NOT NULL)) AS code FROM x)"""
)
def dq_rules(spark, d):
    c = F.col
    x = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", c("l_quantity").cast("long").alias("mv_len"), ((c("l_quantity") * 6).cast("long") + F.when(c("l_partkey") % 11 == 0, 1).otherwise(0)).alias("sig_len"),
        (c("l_suppkey") % 90 - 2).alias("mv_off"), (c("l_suppkey") % 700 - 2).alias("sig_off"), F.lit(100).alias("mv_size"), F.lit(800).alias("sig_size"), F.lit(6).alias("stride"),
    )
    return rules.issues(x, rules.slice_rules("mv_off", "mv_len", "mv_size", "sig_off", "sig_len", "sig_size", "stride"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def whole_segments(spark, d):
    return rules.whole_segments(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", F.col("l_quantity") <= 49).drop("l_quantity")


@query(
    """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn AS left_turn, turn AS right_turn, role FROM conversations"""
)
def zip_join(spark, d):
    c = table(spark, d, "conversations")
    a = c.select("conv_id", F.col("turn").alias("left_turn"))
    b = c.select("conv_id", F.col("turn").alias("right_turn"), "role")
    return keyed.zip_join(a, b, "conv_id", ["left_turn"], ["right_turn"], "left_turn", "right_turn")


@query(
    """WITH a AS (SELECT l_partkey, l_orderkey AS left_order, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem),
    b AS (SELECT l_partkey, l_orderkey AS right_order, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_returnflag = 'R')
    SELECT l_partkey, k, left_order, right_order FROM a JOIN b USING (l_partkey, k)"""
)
def kth_occurrence_join(spark, d):
    li = table(spark, d, "lineitem")
    a = li.select("l_partkey", F.col("l_orderkey").alias("left_order"), "l_linenumber")
    b = li.where("l_returnflag = 'R'").select("l_partkey", F.col("l_orderkey").alias("right_order"), "l_shipdate", F.col("l_linenumber").alias("r_line"))
    return keyed.occurrence_join(a, b, "l_partkey", ["left_order", "l_linenumber"], ["l_shipdate", "right_order", "r_line"]).select("l_partkey", "k", "left_order", "right_order")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_reads(spark, d):
    keys = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return keyed.wanted(table(spark, d, "orders").select("o_orderkey", "o_custkey"), keys, "o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_keys(spark, d):
    return keyed.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query(
    """SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split
    FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint / 4294967296.0::double AS u FROM documents)"""
)
def deterministic_split(spark, d):
    return ordered.hash_split(table(spark, d, "documents").select("doc_id"), F.col("doc_id"))


@query(
    """WITH m AS (SELECT user_id, quantile_disc(value, 0.5) AS med FROM events GROUP BY user_id),
    a AS (SELECT user_id, quantile_disc(abs(value - med), 0.5) AS mad FROM events JOIN m USING (user_id) GROUP BY user_id)
    SELECT event_id, round((value - med) / greatest(mad, 1e-6), 6) AS z FROM events JOIN m USING (user_id) JOIN a USING (user_id)"""
)
def robust_norm(spark, d):
    z = metrics.robust_scaled(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "value")
    return z.select("event_id", F.round("z", 6).alias("z"))


@query(SQL["robust_norm"])
def robust_norm_hot(spark, d):
    """Medians of users with over 40 events are selected over all tasks."""
    z = metrics.robust_scaled(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "value", slice_rows=40)
    return z.select("event_id", F.round("z", 6).alias("z"))


_LABELS = """SELECT vec_id, list_transform(range(16), lambda t: list_position(embedding[t * 4 + 1:t * 4 + 4], list_max(embedding[t * 4 + 1:t * 4 + 4])) - 1) AS labels FROM embeddings"""


def frame_labels(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.transform(sq.rows_of(F.col("embedding"), 4), sq.argmax).alias("labels"))


@query(
    f"""SELECT vec_id, array_to_string(list_transform(list_filter(range(1, 17), lambda i: labels[i] <> 0 AND (i = 1 OR labels[i - 1] <> labels[i])), lambda i: 'ACG'[labels[i]]), '') AS read FROM ({_LABELS})"""
)
def ctc_greedy(spark, d):
    return frame_labels(spark, d).select("vec_id", sq.greedy_ctc(F.col("labels")).alias("read"))


@query(
    f"""SELECT vec_id, 16 + len(list_filter(range(2, 17), lambda i: labels[i] = labels[i - 1])) AS frames FROM ({_LABELS})"""
)
def ctc_min_len(spark, d):
    return frame_labels(spark, d).select("vec_id", sq.ctc_length(F.col("labels")).cast("long").alias("frames"))


@query(
    f"""WITH u AS (SELECT vec_id, unnest(range(1, 17)) AS i, unnest(labels) AS x FROM ({_LABELS})),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id, x ORDER BY i) AS island FROM u),
    r AS (SELECT vec_id, max(n) AS run FROM (SELECT vec_id, x, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY vec_id)
    SELECT vec_id, run::int AS run, CASE WHEN run <= 2 THEN 1.0 ELSE 1 + (least(run, 6) - 2) / 4.0::double END AS weight FROM r"""
)
def homopolymer_weight(spark, d):
    x = frame_labels(spark, d).withColumn("run", sq.longest_run(F.col("labels")))
    return x.select("vec_id", "run", sq.homopolymer_weight(F.col("run"), 2, 6, 2.0).alias("weight"))


_MOVES = "SELECT vec_id, list_transform(embedding::float[], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS moves FROM embeddings"


def moves_of(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)).alias("moves"))


@query(
    f"""WITH h AS (SELECT vec_id, list_filter(range(0, 64), lambda i: moves[i + 1] <> 0) AS h FROM ({_MOVES}))
    SELECT vec_id, h[3]::int AS tick, (coalesce(h[least(len(h), 8) + 1], h[least(len(h), 8)] + 1) - h[3])::int AS mv_len,
    ((coalesce(h[least(len(h), 8) + 1], h[least(len(h), 8)] + 1) - h[3]) * 6)::int AS sig_len FROM h WHERE least(len(h), 8) > 2"""
)
def move_slice(spark, d):
    p = sq.move_slice(F.col("moves"), F.lit(2), F.lit(8), F.lit(6))
    return moves_of(spark, d).select("vec_id", p.alias("p")).where("p is not null").select("vec_id", "p.tick", "p.mv_len", "p.sig_len")


@query(
    f"""SELECT vec_id, array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN moves[i] > 0 THEN repeat('ACGT', 16)[list_sum(moves[1:i])::int] ELSE '.' END), '') AS bases FROM ({_MOVES})"""
)
def move_expand(spark, d):
    x = moves_of(spark, d).withColumn("seq", F.substring(F.repeat(F.lit("ACGT"), 16), F.lit(1), F.aggregate("moves", F.lit(0), lambda a, m: a + m)))
    b = sq.expand_bases(F.col("seq"), F.transform("moves", lambda m: m.cast("bigint")))
    return x.select("vec_id", F.array_join(F.transform(b, lambda s: F.when(s == "", ".").otherwise(s)), "").alias("bases"))


@query(
    """WITH s AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS s FROM documents),
    c AS (SELECT doc_id, s, ((length(s) - 1) // 2) AS mid, s[((length(s) - 1) // 2) + 1] AS b FROM s WHERE length(s) > 0),
    r AS (SELECT doc_id, s, (mid + 1 - (length(s[:mid + 1]) - length(rtrim(s[:mid + 1], b)))) AS a, (mid + (length(s[mid + 1:]) - length(ltrim(s[mid + 1:], b)))) AS z FROM c)
    SELECT doc_id, a::int AS run_start, z::int AS run_end, lpad(s[greatest(a - 3, 0) + 1:a], 3, 'N') AS left_3mer, rpad(s[z + 1:z + 3], 3, 'N') AS right_3mer FROM r"""
)
def central_homopolymer(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("s")).where("length(s) > 0")
    x = s.withColumn("r", sq.central_run(F.col("s"))).select("doc_id", "s", F.col("r.start").alias("run_start"), F.col("r.end").alias("run_end"))
    left, right = sq.flanks(F.col("s"), F.col("run_start"), F.col("run_end"))
    return x.select("doc_id", "run_start", "run_end", left.alias("left_3mer"), right.alias("right_3mer"))


_PAIRS = """SELECT a.p_partkey AS k, a.p_name AS ref, b.p_name AS hyp FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"""


def pairs(spark, d):
    """Each part's name with the next part's."""
    p = table(spark, d, "part")
    a, b = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("ref")), p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("hyp"))
    return a.join(b, "k")


@query(f"SELECT k, levenshtein(ref, hyp)::int AS distance FROM ({_PAIRS})")
def levenshtein_pairs(spark, d):
    return pairs(spark, d).select("k", F.levenshtein("ref", "hyp").alias("distance"))


@query(f"SELECT k, levenshtein(ref, hyp)::int AS distance FROM ({_PAIRS})")
def alignment_distance(spark, d):
    """The distance that the traceback alignment finds."""
    return pairs(spark, d).select("k", align.alignment_stats("ref", "hyp").alias("a")).select("k", "a.distance")


@query(
    """SELECT count(*) AS n, round(avg(levenshtein(ref, hyp)), 9) AS mean_distance, round(avg(levenshtein(ref, hyp)::double / length(ref)), 9) AS mean_normalised FROM (""" + _PAIRS + """)"""
)
def alignment_errors(spark, d):
    """The part of alignment_metrics that does not depend on which of several best alignments is taken."""
    out = alignment_metrics(spark, d)
    return out.select("n", F.round("mean_distance", 9).alias("mean_distance"), F.round("mean_normalised", 9).alias("mean_normalised"))


@query()
def alignment_metrics(spark, d):
    a = pairs(spark, d).select("k", F.length("ref").alias("ref_len"), align.alignment_stats("ref", "hyp").alias("a")).select("k", "ref_len", "a.*")
    return metrics.accuracy(a, "matches", "length", "ref_len", "distance")


@query(
    """SELECT source, count(*) AS n, round(avg(CASE WHEN n_chars > 0 THEN quality * 1.0::double / n_chars ELSE 1 END), 9) AS macro, round(CASE WHEN sum(n_chars) > 0 THEN sum(quality)::double / sum(n_chars) ELSE 1 END, 9) AS micro
    FROM labels JOIN documents USING (doc_id) GROUP BY source"""
)
def macro_micro_accuracy(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    out = metrics.accuracy(x, "quality", "n_chars", "n_chars", "toxic", "source")
    return out.select("source", "n", F.round("macro_aligned", 9).alias("macro"), F.round("micro_aligned", 9).alias("micro"))


@query("SELECT label, max(len(list_filter(embedding::float[], lambda x: x > 0))) AS budget FROM embeddings GROUP BY label")
def query_budget(spark, d):
    n = F.size(F.filter("embedding", lambda x: x > 0)).cast("long")
    return table(spark, d, "embeddings").groupBy("label").agg(F.max(n).alias("budget"))


@query(
    """WITH f AS (SELECT vec_id, unnest(range(16)) AS t, embedding::double[] AS e FROM embeddings),
    p AS (SELECT vec_id, exp(e[t * 4 + 1] - list_max(e[t * 4 + 1:t * 4 + 4])) / list_sum(list_transform(e[t * 4 + 1:t * 4 + 4], lambda x: exp(x - list_max(e[t * 4 + 1:t * 4 + 4])))) AS p FROM f)
    SELECT vec_id, round(avg(p), 6) AS mean_blank, round(min(p), 6) AS least, round(max(p), 6) AS most, count(*) FILTER (p > 0.5) AS sure FROM p GROUP BY vec_id"""
)
def blank_stats(spark, d):
    p = metrics.class_probability(table(spark, d, "embeddings"), "vec_id", "embedding", 4, sure=0.5)
    return p.select("vec_id", F.round("mean", 6).alias("mean_blank"), F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), "sure")


@query(
    """SELECT user_id, round(avg(greatest(60 - gap, 0)), 6) AS violation FROM (SELECT user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY event_id)) - epoch_us(ts)) / 1e6 AS gap FROM events) WHERE gap IS NOT NULL GROUP BY user_id"""
)
def temporal_order(spark, d):
    v = metrics.order_violation(table(spark, d, "events"), "user_id", "event_id", seconds("ts") / F.lit(1e6), 60)
    return v.select("user_id", F.round("violation", 6).alias("violation"))


@query(
    """WITH x AS (SELECT l_orderkey, l_linenumber, 60 AS n, l_linenumber * 5 - 3 AS s, l_linenumber * 5 - 3 + l_quantity::int AS e, l_partkey % 2 = 1 AS r FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN r THEN greatest(0, n - e) ELSE greatest(0, least(s, n)) END AS a,
    CASE WHEN r THEN greatest(greatest(0, n - e), n - s) ELSE greatest(greatest(0, least(s, n)), greatest(0, least(e, n))) END AS b FROM x"""
)
def strand_flip(spark, d):
    s = F.col("l_linenumber") * 5 - 3
    a, b = sq.flip_span(s, s + F.col("l_quantity").cast("int"), F.lit(60), F.col("l_partkey") % 2 == 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))


@query(
    """SELECT o_orderkey, 'chr' || o_custkey % 30 AS chrom, (o_orderkey % 1000)::int AS start, (o_orderkey % 1000 + 200)::int AS "end", 'chr' || o_custkey % 30 || '_' || o_orderkey % 1000 || '_' || (o_orderkey % 1000 + 200) AS safe_name
    FROM orders WHERE o_custkey % 30 BETWEEN 1 AND 22 AND o_orderkey % 5 <> 0"""
)
def region_parse(spark, d):
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("# note")).otherwise(F.concat(F.lit(" chr"), F.col("o_custkey") % 30, F.lit(":"), F.col("o_orderkey") % 1000, F.lit("-"), F.col("o_orderkey") % 1000 + 200))
    return tiling.parse_regions(o.select("o_orderkey", text.alias("value")), keep=("o_orderkey",)).select("o_orderkey", "chrom", "start", "end", "safe_name")


@query(
    """WITH v AS (SELECT o_orderkey, ['A', 'T', '*'] AS alts, o_orderkey % 5 AS a, o_custkey % 4 AS b, o_orderkey % 3 = 0 AS bar FROM orders)
    SELECT o_orderkey, CASE WHEN bar AND a BETWEEN 1 AND 2 THEN alts[a] ELSE '' END AS hap1, CASE WHEN bar AND b BETWEEN 1 AND 2 THEN alts[b] ELSE '' END AS hap2 FROM v"""
)
def vcf_gt(spark, d):
    o = table(spark, d, "orders")
    sample = F.concat(F.lit("30:"), F.col("o_orderkey") % 5, F.when(F.col("o_orderkey") % 3 == 0, "|").otherwise("/"), F.col("o_custkey") % 4)
    a, b = sq.genotype(F.lit("DP:GT"), sample, F.lit("A,T,*"))
    return o.select("o_orderkey", a.alias("hap1"), b.alias("hap2"))


@query(
    """SELECT l_returnflag, count(*) AS total, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_quantity >= 20) AS passing, count(*) FILTER (l_discount = 0) AS plain FROM lineitem GROUP BY l_returnflag"""
)
def chrom_counters(spark, d):
    return metrics.counters(table(spark, d, "lineitem"), ["l_returnflag"], open=F.col("l_linestatus") == "O", passing=F.col("l_quantity") >= 20, plain=F.col("l_discount") == 0)


@query("SELECT l_orderkey, sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def region_totals(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT doc_id, reverse(translate(upper(regexp_replace(upper(text), '[^ACGT]', '', 'g')), 'ACGT', 'TGCA')) AS rc FROM documents"""
)
def reverse_complement(spark, d):
    return table(spark, d, "documents").select("doc_id", sq.reverse_complement(F.regexp_replace(F.upper("text"), "[^ACGT]", "")).alias("rc"))


@query(
    """SELECT p_partkey, p_size % 7 + 12 AS ref_span, p_size % 7 + 14 AS query_span, '3S' || (p_size % 7 + 5) || 'M2D4M1I1M1S' AS cigar FROM part"""
)
def cigar_spans(spark, d):
    text = F.concat(F.lit("3S"), F.col("p_size") % 7 + 5, F.lit("M2D4M1I1M1S"))
    x = table(spark, d, "part").select("p_partkey", sq.parse_cigar(text).alias("c"))
    return x.select("p_partkey", sq.reference_span(F.col("c")).cast("int").alias("ref_span"), (sq.query_span(F.col("c")) - 1).cast("int").alias("query_span"), sq.cigar_text(F.col("c")).alias("cigar"))


@query(
    """WITH x AS (SELECT p_partkey, p_size % 12 + 100 AS a FROM part)
    SELECT p_partkey, a, (3 + CASE WHEN a < 105 THEN a - 100 WHEN a < 107 THEN 5 WHEN a < 111 THEN a - 102 ELSE a - 101 END)::int AS qs,
      CASE WHEN a + 5 < 107 THEN 8 WHEN a + 5 < 111 THEN 3 + a + 5 - 102 WHEN a + 5 < 114 THEN 3 + a + 5 - 101 ELSE 18 END::int AS qe FROM x"""
)
def cigar_lift(spark, d):
    x = table(spark, d, "part").select("p_partkey", sq.parse_cigar(F.lit("3S5M2D4M1I3M2S")).alias("c"), (F.col("p_size") % 12 + 100).alias("a"))
    return x.select("p_partkey", "a", align.lifted("c", F.lit(100), "a", F.col("a") + 5).alias("q")).select("p_partkey", "a", "q.qs", "q.qe")


@query(
    """SELECT p_partkey, 'AT' || CASE WHEN p_size % 6 = 0 THEN 'GTGGACGTAC' WHEN p_size % 6 = 4 THEN 'GTACGTGGAC' ELSE 'GTACGTAC' END AS hap FROM part"""
)
def spike_in(spark, d):
    v = F.array(F.struct(F.lit(12).alias("pos"), F.lit("C").alias("ref"), F.lit("T").alias("alt")), F.struct((F.col("p_size") % 6 + 14).alias("pos"), F.lit("T").alias("ref"), F.lit("TGG").alias("alt")))
    return table(spark, d, "part").select("p_partkey", align.spiked(F.lit("ACGTACGTAC"), F.lit(11), v).alias("hap"))


@query()
def prefix_beam(spark, d):
    return table(spark, d, "embeddings").select("vec_id", decode.beam_udf(4, "ACG", 20)("embedding").alias("b")).select("vec_id", "b.text", F.round("b.log_prob", 6).alias("log_prob"))


@query()
def window_poa(spark, d):
    """One sequence from each conversation's whole turns."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.upper("text").alias("seq"))
    return partial_order.window_poa(c, ["conv_id"], "turn", "seq")


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return covered_segments(spark, sf_dir)
