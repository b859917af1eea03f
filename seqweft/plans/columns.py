"""Queries of single column functions, beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..functions import signal as sg
from .queries import frame_labels, query, table

_E = "SELECT vec_id, label, embedding::double[] AS e FROM embeddings"
_LABELS = """SELECT vec_id, list_transform(range(16), lambda t: list_position(embedding[t * 4 + 1:t * 4 + 4], list_max(embedding[t * 4 + 1:t * 4 + 4])) - 1) AS labels FROM embeddings"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


@query("SELECT doc_id, NOT regexp_matches(upper(text), '[^ACGT]') AS plain, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS bases FROM documents WHERE regexp_matches(text, '[ACGTacgt]')")
def sanitised(spark, d):
    x = table(spark, d, "documents").where(F.col("text").rlike("[ACGTacgt]"))
    return x.select("doc_id", sq.only_acgt(F.upper("text")).alias("plain"), sq.sanitise(F.translate("text", "acgt", "ACGT")).alias("bases"))


@query("SELECT doc_id, substr(text, 11, least(greatest(n_chars - 10, 0), 30)::int) AS part FROM (SELECT doc_id, text, length(text) AS n_chars FROM documents)")
def cut(spark, d):
    return table(spark, d, "documents").select("doc_id", sq.cut(F.col("text"), F.lit(10), F.lit(40)).alias("part"))


@query(
    f"""WITH q AS (SELECT vec_id, list_transform(e, lambda x: (floor(abs(x) * 300))::int) AS q FROM ({_E}))
    SELECT vec_id, round(coalesce(list_avg(list_filter(q, lambda v: v <= 60)), 0), 6) AS mean, array_to_string(list_transform(q, lambda v: chr(v + 33)), '') AS text FROM q"""
)
def qualities(spark, d):
    q = F.transform("e", lambda x: F.floor(F.abs(x) * 300).cast("int"))
    x = _vectors(spark, d).select("vec_id", q.alias("q"))
    return x.select("vec_id", F.round(sq.mean_quality(F.col("q")), 6).alias("mean"), sq.phred_text(F.col("q"), F.size("q")).alias("text"))


@query(
    f"""SELECT vec_id, array_to_string(list_transform(range(1, 17), lambda i: CASE WHEN labels[i] = labels[i - 1] OR labels[i] = labels[i + 1] THEN '1' ELSE '0' END), '') AS mask FROM ({_LABELS})"""
)
def run_mask(spark, d):
    m = sq.run_mask(F.col("labels"), 2)
    return frame_labels(spark, d).select("vec_id", F.array_join(F.transform(m, lambda v: v.cast("int").cast("string")), "").alias("mask"))


@query(
    f"""SELECT vec_id, array_to_string(list_transform(list_filter(range(1, 65), lambda i: e[i] > 0), lambda i: CASE WHEN i % 6 BETWEEN 1 AND 4 THEN 'ACGT'[i % 6] ELSE 'N' END), '') AS read FROM ({_E})"""
)
def recover_read(spark, d):
    bases = F.transform("e", lambda x, i: (i + 1) % 6)
    return _vectors(spark, d).select("vec_id", sq.recover_read(F.transform("e", lambda x: F.when(x > 0, 1.0).otherwise(0.0)), bases).alias("read"))


@query(f"SELECT vec_id, round(list_sum(list_transform(e, lambda x: CASE WHEN abs(x) > 0.2 THEN 0 ELSE x END)), 6) AS total FROM ({_E})")
def clean_values(spark, d):
    x = F.transform("e", lambda v: F.when(v > 0.2, float("inf")).when(v < -0.2, float("nan")).otherwise(v))
    return _vectors(spark, d).select("vec_id", F.round(F.aggregate(sq.clean(x), F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(f"SELECT vec_id, (64 + label)::bigint AS n, round(list_sum(e) + 0.5 * label, 6) AS total FROM ({_E})")
def padded(spark, d):
    p = sq.padded(F.col("e"), F.col("label") + 64, 0.5)
    x = _vectors(spark, d).select("vec_id", p.alias("p"))
    return x.select("vec_id", F.size("p").cast("long").alias("n"), F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("SELECT l_orderkey, l_linenumber, round(ln(exp(l_discount) + exp(l_tax)), 6) AS both FROM lineitem")
def log_add(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(sq.log_add(F.col("l_discount"), F.col("l_tax")), 6).alias("both"))


@query(
    """SELECT l_orderkey, l_linenumber, round(l_tax, 6) AS f0, round(l_tax * l_tax, 6) AS f1, round(sin(2 * pi() * l_tax), 6) AS f2, round(sin(6 * pi() * l_tax), 6) AS f3, round(cos(2 * pi() * l_tax), 6) AS f4, round(cos(6 * pi() * l_tax), 6) AS f5 FROM lineitem"""
)
def fourier_features(spark, d):
    f = sg.fourier_features(F.col("l_tax"), [1.0, 3.0])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(F.get(f, F.lit(i)), 6).alias(f"f{i}") for i in range(6)))


@query(f"SELECT vec_id, round(list_avg(list_transform(e, lambda x: greatest(x, 0) - x * least(greatest(x + 0.5, 0), 1) + ln(1 + exp(-abs(x))))), 6) AS loss FROM ({_E})")
def duration_loss(spark, d):
    t = F.transform("e", lambda x: F.least(F.greatest(x + 0.5, F.lit(0.0)), F.lit(1.0)))
    return _vectors(spark, d).select("vec_id", F.round(sg.duration_loss(F.col("e"), t), 6).alias("loss"))


@query(
    f"""WITH s AS (SELECT vec_id, list_transform(range(8), lambda t: list_position(e[t * 8 + 1:t * 8 + 8], list_max(e[t * 8 + 1:t * 8 + 8])) - 1) AS s FROM ({_E}))
    SELECT vec_id, len(list_filter(s, lambda v: v < 4)) AS enter, len(list_filter(s, lambda v: v >= 4)) AS extend, len(list_filter(range(2, 9), lambda i: s[i] < 4 AND s[i - 1] % 4 = s[i])) AS reentered FROM s"""
)
def enter_rates(spark, d):
    s = F.transform(sq.rows_of(F.col("e"), 8), sq.argmax)
    x = _vectors(spark, d).select("vec_id", s.alias("s")).select("vec_id", sg.enter_rates(F.col("s")).alias("r"))
    return x.select("vec_id", F.col("r.enter").cast("long").alias("enter"), F.col("r.extend").cast("long").alias("extend"), F.col("r.reentered").cast("long").alias("reentered"))


@query(
    """WITH v AS (SELECT o_orderkey, ['A', 'T', '*'] AS alts, o_orderkey % 5 AS a, o_custkey % 4 AS b, o_orderkey % 3 = 0 AS bar FROM orders),
    p AS (SELECT *, CASE WHEN a BETWEEN 1 AND 2 THEN alts[a] ELSE '' END AS x, CASE WHEN b BETWEEN 1 AND 2 THEN alts[b] ELSE '' END AS y,
      CASE WHEN a = 0 THEN b WHEN b = 0 THEN a ELSE least(a, b) END AS m FROM v)
    SELECT o_orderkey, x AS any1, y AS any2, CASE WHEN bar THEN x WHEN m BETWEEN 1 AND 2 THEN alts[m] ELSE '' END AS un1, CASE WHEN bar THEN y WHEN m BETWEEN 1 AND 2 THEN alts[m] ELSE '' END AS un2 FROM p"""
)
def vcf_gt_policies(spark, d):
    o = table(spark, d, "orders")
    sample = F.concat(F.lit("30:"), F.col("o_orderkey") % 5, F.when(F.col("o_orderkey") % 3 == 0, "|").otherwise("/"), F.col("o_custkey") % 4)
    a, b = sq.genotype(F.lit("DP:GT"), sample, F.lit("A,T,*"), "any")
    c, e = sq.genotype(F.lit("DP:GT"), sample, F.lit("A,T,*"), "unphased")
    return o.select("o_orderkey", a.alias("any1"), b.alias("any2"), c.alias("un1"), e.alias("un2"))
