"""Queries that evaluate decoded reads and signals, beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import align, decode
from ..functions import sequence as sq
from ..functions import signal as sg
from ..operators import metrics
from .queries import frame_labels, pairs, query, table

_LABELS = """SELECT vec_id, label, list_transform(range(16), lambda t: list_position(embedding[t * 4 + 1:t * 4 + 4], list_max(embedding[t * 4 + 1:t * 4 + 4])) - 1) AS labels FROM embeddings"""


@query()
def homopolymer_accuracy(spark, d):
    """Of reference letters in runs of two at least. Which best alignment is taken decides, so SQL has no say; tests count by hand."""
    return metrics.homopolymer_accuracy(pairs(spark, d), "ref", "hyp", 2)


@query(
    """SELECT source, count(*) AS n, round(avg(length(coalesce(lang, ''))), 9) AS mean_collapsed, round(avg(n_chars), 9) AS mean_n_chars, count(*) FILTER (coalesce(lang, '') = '') AS zero_length FROM documents GROUP BY source"""
)
def decode_summary(spark, d):
    out = metrics.decode_summary(table(spark, d, "documents"), "lang", "n_chars", by=("source",))
    return out.select("source", "n", F.round("mean_collapsed", 9).alias("mean_collapsed"), F.round("mean_n_chars", 9).alias("mean_n_chars"), "zero_length")


@query(
    f"""SELECT vec_id, round(len(list_filter(labels, lambda x: x = 0)) / 16.0::double, 9) AS blank_rate, k AS collapsed_len, round(k::double / (label + 1), 9) AS collapsed_ref_ratio
    FROM (SELECT *, len(list_filter(range(1, 17), lambda i: labels[i] <> 0 AND (i = 1 OR labels[i - 1] <> labels[i]))) AS k FROM ({_LABELS}))"""
)
def blank_rates(spark, d):
    x = frame_labels(spark, d).join(table(spark, d, "embeddings").select("vec_id", (F.col("label") + 1).alias("ref_len")), "vec_id")
    out = metrics.blank_rates(x, "labels", "ref_len")
    return out.select("vec_id", F.round("blank_rate", 9).alias("blank_rate"), F.col("collapsed_len").cast("long").alias("collapsed_len"), F.round("collapsed_ref_ratio", 9).alias("collapsed_ref_ratio"))


@query(
    """WITH m AS (SELECT o_orderstatus, c_custkey, max(nullif(greatest(o_totalprice - 50000, 0), 0)) AS longest FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
    SELECT o_orderstatus, count(longest) AS evaluated, count(*) FILTER (longest IS NULL) AS missing, count(*) FILTER (longest > 200000) AS exceeding FROM m GROUP BY o_orderstatus"""
)
def long_references(spark, d):
    x = table(spark, d, "orders").select("o_orderstatus", "o_custkey", F.greatest(F.col("o_totalprice") - 50000, F.lit(0.0)).alias("length"))
    return metrics.long_references(x, "o_custkey", "length", 200000, "o_orderstatus")


@query("SELECT l_returnflag, count(*) AS issues, count(DISTINCT l_orderkey) AS segments FROM lineitem WHERE l_quantity > 45 GROUP BY l_returnflag")
def issue_totals(spark, d):
    return metrics.issue_totals(table(spark, d, "lineitem").where("l_quantity > 45"), "l_returnflag", "l_orderkey")


@query("SELECT l_linenumber, count(l_discount) AS n, round(avg(l_discount), 9) AS mean, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean_weighted FROM lineitem GROUP BY l_linenumber")
def loss_averages(spark, d):
    out = metrics.loss_averages(table(spark, d, "lineitem"), "l_linenumber", "l_discount", "l_quantity")
    return out.select("l_linenumber", "n", F.round("mean", 9).alias("mean"), F.round("mean_weighted", 9).alias("mean_weighted"))


@query("SELECT l_returnflag, round(avg((l_tax - l_discount) * (l_tax - l_discount)), 9) AS mse FROM lineitem GROUP BY l_returnflag")
def squared_errors(spark, d):
    return metrics.mean_squared_error(table(spark, d, "lineitem"), "l_discount", "l_tax", "l_returnflag").select("l_returnflag", F.round("mse", 9).alias("mse"))


@query(
    """SELECT doc_id, array_to_string(list_transform(string_split(s, ''), lambda x: CASE x WHEN 'A' THEN '0' WHEN 'C' THEN '1' WHEN 'G' THEN '2' WHEN 'T' THEN '3' ELSE '4' END), '') AS codes,
    regexp_replace(s, '[^ACGT]', 'N', 'g') AS back FROM (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents)"""
)
def base_codes(spark, d):
    x = table(spark, d, "documents").select("doc_id", sq.base_codes(F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))).alias("c"))
    return x.select("doc_id", F.array_join(F.col("c").cast("array<string>"), "").alias("codes"), sq.from_base_codes(F.col("c")).alias("back"))


@query(
    f"""SELECT vec_id, array_to_string(list_transform(labels, lambda x: CASE x WHEN 0 THEN '1000' WHEN 1 THEN '0100' WHEN 2 THEN '0010' ELSE '0001' END), '') AS bits FROM ({_LABELS})"""
)
def one_hot(spark, d):
    x = sq.one_hot(F.col("labels"))
    return frame_labels(spark, d).select("vec_id", F.array_join(F.transform(F.flatten(x), lambda v: v.cast("int").cast("string")), "").alias("bits"))


@query(f"SELECT vec_id, array_to_string(list_transform(labels, lambda x: repeat('-ACG'[x + 1], (x + 1)::int)), '') AS text FROM ({_LABELS})")
def runs_text(spark, d):
    runs = F.transform("labels", lambda x: F.struct(F.substring(F.lit("-ACG"), x + 1, F.lit(1)).alias("char"), (x + 1).alias("n")))
    return frame_labels(spark, d).select("vec_id", sq.runs_text(runs).alias("text"))


_WEIGHTS = """SELECT vec_id, list_transform(embedding::double[], lambda x: abs(x) / list_sum(list_transform(embedding::double[], lambda y: abs(y)))) AS w, embedding::double[] AS e FROM embeddings"""


@query(
    f"""SELECT vec_id, round(-list_sum(list_transform(w, lambda x: x * ln(greatest(x, 1e-6)))), 6) AS entropy,
    round(list_sum(list_transform(range(1, 65), lambda i: w[i] * (e[i] - list_sum(list_transform(range(1, 65), lambda j: w[j] * e[j]))) ** 2)), 6) AS variance FROM ({_WEIGHTS})"""
)
def attention_spread(spark, d):
    e = F.col("embedding").cast("array<double>")
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + F.abs(x))
    x = table(spark, d, "embeddings").select("vec_id", e.alias("e"), total.alias("t")).withColumn("w", F.transform("e", lambda v: F.abs(v) / F.col("t")))
    spread = sq.weighted_variance(F.col("w"), F.transform("e", lambda v: F.array(v)))
    return x.select("vec_id", F.round(sq.entropy(F.col("w")), 6).alias("entropy"), F.round(spread, 6).alias("variance"))


@query(
    """SELECT vec_id, round(greatest(0, least(1, list_sum(list_transform(range(1, 17), lambda i: 0.25 * (e[i] * e[i + 16]) + 0.75 * (e[i + 32] * e[i + 48]))))), 6) AS target
    FROM (SELECT vec_id, embedding::double[] AS e FROM embeddings)"""
)
def duration_target(spark, d):
    """Two reads with one query each: a quarter and three quarters of attention times moves."""
    e = F.col("embedding").cast("array<double>")
    part = lambda k: F.slice(e, k * 16 + 1, 16)
    t = sq.duration_target(F.array(F.array(part(0)), F.array(part(2))), F.array(part(1), part(3)), F.array(F.lit(0.25), F.lit(0.75)), F.array(F.lit(True)))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(t, F.lit(0)), 6).alias("target"))


@query(f"SELECT vec_id, 16 + len(list_filter(range(2, 17), lambda i: labels[i] = labels[i - 1])) <= 20 AS fits FROM ({_LABELS})")
def decoder_budget(spark, d):
    return frame_labels(spark, d).select("vec_id", sq.fits_frames(F.col("labels"), F.lit(20)).alias("fits"))


@query(
    f"""SELECT vec_id, len(list_filter(range(1, 17), lambda i: labels[i] <> 0)) AS n FROM ({_LABELS})"""
)
def masked_rows(spark, d):
    x = sq.masked_rows(F.col("labels"), F.transform("labels", lambda v: v != 0))
    return frame_labels(spark, d).select("vec_id", F.size(x).cast("long").alias("n"))


@query()
def ctc_likelihood(spark, d):
    """Negative log-likelihood of the labels of each row's first four frames; tests hold it against all alignments."""
    x = table(spark, d, "embeddings").select("vec_id", "embedding", F.transform(F.slice(F.transform(sq.rows_of(F.col("embedding"), 4), sq.argmax), 1, 4), lambda v: F.greatest(v, F.lit(1))).alias("labels"))
    return x.select("vec_id", F.round(decode.ctc_nll_udf(4)("embedding", "labels"), 6).alias("nll"))


@query()
def enter_extend(spark, d):
    """The best path over eight states; tests hold it against all paths."""
    return table(spark, d, "embeddings").select("vec_id", decode.enter_extend_udf()("embedding").alias("b")).select("vec_id", "b.text", F.round("b.score", 4).alias("score"))


@query()
def crf_likelihood(spark, d):
    """Of two labels over eight states; tests hold it against all paths."""
    x = table(spark, d, "embeddings").select("vec_id", "embedding", F.array((F.col("label") % 4).cast("int"), (F.col("vec_id") % 4).cast("int")).alias("labels"))
    return x.select("vec_id", F.round(decode.crf_nll_udf()("embedding", "labels"), 4).alias("nll"))


@query(
    f"""WITH c AS (SELECT vec_id, labels, list_filter(range(1, 17), lambda i: labels[i] <> 0 AND (i = 1 OR labels[i - 1] <> labels[i])) AS b FROM ({_LABELS}))
    SELECT vec_id, array_to_string(list_transform(b, lambda i: 'ACG'[labels[i]]), '') AS text, len(list_filter(labels, lambda x: x <> 0)) AS frames FROM c"""
)
def blank_path(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", decode.blank_viterbi_udf(4, "ACG")("embedding").alias("b"))
    total = F.aggregate(F.col("b.frames"), F.lit(0).cast("long"), lambda s, v: s + v)
    return x.select("vec_id", "b.text", total.alias("frames"))


@query()
def indel_distances(spark, d):
    """Of neighbouring parts' names; tests hold it against the longest common subsequence."""
    return pairs(spark, d).select("k", align.indel_distances("ref", "hyp").alias("distance"))


@query(
    """SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)) / list_sum(e), 6) AS pooled FROM (SELECT vec_id, list_transform(embedding::double[], lambda x: abs(x)) AS e FROM embeddings)"""
)
def weighted_pooling(spark, d):
    e = F.transform(F.col("embedding").cast("array<double>"), F.abs)
    return table(spark, d, "embeddings").select("vec_id", F.round(sg.weighted_mean(e, e), 6).alias("pooled"))
