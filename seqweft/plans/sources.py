"""Queries of the readers and writers: the tables' rows are written in a format, read again, and held against SQL over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import records
from ..session import scratch
from ..sources import arrays, formats, indexed
from .queries import _READS, query, reads_of, table


def _sam(spark, d) -> str:
    """The reads of lineitem as sorted SAM text."""
    length = (F.col("rend") - F.col("rstart") + 1).cast("string")
    rows = reads_of(spark, d).select(
        F.col("read_id").alias("qname"), (F.col("rstart") % 2 * 16).alias("flag"), F.col("chrom").cast("string").alias("chrom"), (F.col("rstart") - 1).alias("pos"), (F.col("rend") % 60).alias("mapq"),
        F.concat(length, F.lit("M")).alias("cigar"), F.lit("*").alias("seq"), F.lit("*").alias("qual"),
    )
    path = scratch(spark, "sam")
    indexed.write_sorted_sam(rows, path)
    return path


@query(f"SELECT chrom::varchar AS chrom, rstart - 1 AS pos, rend AS reach, (rstart % 2 * 16)::int AS flag, (rend % 60)::int AS mapq, read_id AS qname FROM ({_READS}) WHERE chrom IN (7, 15, 101) AND rstart <= 1500 AND rend > 900")
def indexed_scan(spark, d):
    """Reads of three contigs that overlap [900, 1500), through the index."""
    path = _sam(spark, d)
    indexed.index_sam(spark, path, header=False)
    rows = indexed.read_indexed_sam(spark, path).where(F.col("chrom").isin("7", "15", "101") & (F.col("pos") < 1500) & (F.col("end") > 900))
    return rows.select("chrom", "pos", F.col("end").alias("reach"), "flag", "mapq", "qname")


@query(f"SELECT chrom::varchar AS chrom, rstart - 1 AS pos, read_id AS qname FROM ({_READS}) WHERE chrom IN (0, 1, 10, 100)")
def scan_until(spark, d):
    """Reads of the contigs that come first in the text's order."""
    return indexed.scan_until(spark, _sam(spark, d), ["0", "1", "10", "100"]).select("chrom", "pos", "qname")


_MADE = """SELECT vec_id, list_filter(list_transform(embedding::double[], lambda x: floor(x * 1000)::int), lambda v: v % 3 <> 0) AS signal,
  list_transform(list_filter(embedding::double[], lambda x: x > 0), lambda x: (floor(x * 100)::int) % 2) AS moves FROM embeddings"""


@query(
    f"""SELECT vec_id, sum(len(signal)) OVER w - len(signal) AS signal_offset, len(signal) AS signal_len, sum(len(moves)) OVER w - len(moves) AS moves_offset, len(moves) AS moves_len,
    list_sum(signal)::bigint AS total, array_to_string(moves, '') AS moves FROM ({_MADE}) WINDOW w AS (ORDER BY vec_id)"""
)
def positional_arrays(spark, d):
    """Signals and moves in binary files and back, with their places in the whole."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    signal = F.filter(F.transform("e", lambda x: F.floor(x * 1000).cast("int")), lambda v: v % 3 != 0)
    moves = F.transform(F.filter("e", lambda x: x > 0), lambda x: F.floor(x * 100).cast("int") % 2)
    path = scratch(spark, "arrays")
    arrays.write_arrays(e.select("vec_id", signal.alias("signal"), moves.alias("moves")), path, {"signal": "i2", "moves": "i1"}, ["vec_id"])
    total = F.aggregate("signal", F.lit(0).cast("long"), lambda a, v: a + v)
    return arrays.read_arrays(spark, path).select("vec_id", "signal_offset", "signal_len", "moves_offset", "moves_len", total.alias("total"), F.array_join(F.transform("moves", lambda v: v.cast("string")), "").alias("moves"))


_LETTERS = "SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS seq FROM documents"


def _letters(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"))


@query(f"SELECT doc_id::varchar AS read_id, length(seq) AS length, sha256(seq || repeat('I', length(seq)::int)) AS digest FROM ({_LETTERS}) WHERE seq <> ''")
def fastq_records(spark, d):
    """Letters of documents as FASTQ and back, without empty reads."""
    rows = _letters(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.lit(" of documents")).alias("header"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"))
    path = scratch(spark, "fastq")
    formats.write_lines(formats.fastq_lines(rows, "header", "seq", "qual"), path)
    reads = formats.read_fastq(spark, path)
    lengths = formats.fastq_lengths(reads)
    return reads.select("read_id", F.sha2(F.concat("seq", "qual"), 256).alias("digest")).join(lengths, "read_id")


def _fasta(spark, d) -> str:
    path = scratch(spark, "fasta")
    formats.write_lines(formats.fasta_lines(_letters(spark, d).select(F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit(" doc")).alias("h"), "seq"), "h", "seq"), path)
    return path


@query(f"SELECT 'c' || doc_id AS name, length(seq) AS length, sha256(seq) AS digest FROM ({_LETTERS}) WHERE seq <> ''")
def fasta_records(spark, d):
    """Letters of documents as FASTA and back; lengths of records with letters."""
    read = formats.read_fasta(spark, _fasta(spark, d))
    return read.select("name", F.sha2("seq", 256).alias("digest")).join(formats.fasta_lengths(read).select("name", "length"), "name")


@query(
    f"""SELECT o_orderkey AS region, CASE WHEN seq IS NULL OR seq = '' THEN NULL ELSE upper(substr(seq, greatest(a, 1), greatest(a + 79 - greatest(a, 1) + 1, 0))) END AS seq
    FROM (SELECT o_orderkey, o_custkey, o_orderkey * 53 % 700 - 20 AS a FROM orders) o LEFT JOIN ({_LETTERS}) ON o_custkey = doc_id"""
)
def fasta_slices(spark, d):
    """Places of 80 letters of contigs that were written as FASTA; null where the contig is unknown."""
    contigs = formats.read_fasta(spark, _fasta(spark, d)).where("seq <> ''")
    start = (F.col("o_orderkey") * 53 % 700 - 20).cast("int")
    regions = table(spark, d, "orders").select(F.col("o_orderkey").alias("region"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("chrom"), start.alias("start"), (start + 79).alias("end"))
    return formats.slices(regions, contigs).select("region", "seq")


_CALLS = """SELECT l_partkey::varchar AS chrom, (l_suppkey + l_linenumber)::int AS pos, l_orderkey, CASE WHEN l_quantity % 2 = 0 THEN '0|1' ELSE '1|1' END AS a,
  CASE WHEN l_quantity % 3 = 0 THEN './.' ELSE '0/1' END AS b FROM lineitem"""


@query(f"SELECT chrom, pos, l_orderkey::varchar AS alt, s AS sample, CASE WHEN s = 'a' THEN a ELSE b END || ':9' AS call FROM ({_CALLS}), (VALUES ('a'), ('b')) AS n(s)")
def vcf_samples(spark, d):
    """Two samples' calls in VCF text and back; each part of the text has its own header line."""
    li = table(spark, d, "lineitem")
    a, b = F.when(F.col("l_quantity") % 2 == 0, "0|1").otherwise("1|1"), F.when(F.col("l_quantity") % 3 == 0, "./.").otherwise("0/1")
    call = lambda c: F.concat(c, F.lit(":9"))
    line = F.concat_ws("\t", F.col("l_partkey").cast("string"), (F.col("l_suppkey") + F.col("l_linenumber")).cast("string"), F.lit("."), F.lit("N"), F.col("l_orderkey").cast("string"), F.lit("."), F.lit("."), F.lit("."), F.lit("GT:DP"), call(a), call(b))
    path = scratch(spark, "vcf")

    def with_header(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": ["\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "a", "b"])]})
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns, ["value"])

    formats.write_lines(li.select(line.alias("value")).mapInArrow(with_header, "value string"), path)
    return formats.read_vcf_samples(spark, path).select("chrom", "pos", "alt", "sample", "call")


@query(f"SELECT chrom, pos, l_orderkey::varchar AS alt, a || ':9' AS sample FROM ({_CALLS})")
def vcf_records(spark, d):
    """The first sample's column of VCF text."""
    li = table(spark, d, "lineitem")
    a = F.when(F.col("l_quantity") % 2 == 0, "0|1:9").otherwise("1|1:9")
    line = F.concat_ws("\t", F.col("l_partkey").cast("string"), (F.col("l_suppkey") + F.col("l_linenumber")).cast("string"), F.lit("."), F.lit("N"), F.col("l_orderkey").cast("string"), F.lit("."), F.lit("."), F.lit("."), F.lit("GT:DP"), a)
    path = scratch(spark, "vcf")
    formats.write_lines(li.select(line.alias("value")), path)
    return formats.read_vcf(spark, path).select("chrom", "pos", "alt", "sample")


@query("SELECT vec_id::varchar AS read_id, 2 AS stride, list_sum(list_transform(embedding::double[], lambda x: CASE WHEN x > 0.1 THEN 1 ELSE 0 END))::bigint AS moved FROM embeddings")
def sam_moves(spark, d):
    """Move tags of reads that stand twice in SAM text: the later record counts."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    moves = F.array_join(F.transform("e", lambda x: F.when(x > F.col("k") * 0.1, "1").otherwise("0")), ",")
    tag = F.concat(F.lit("mv:B:c,"), (F.col("k") + 1).cast("string"), F.lit(","), moves)
    line = F.concat_ws("\t", F.col("vec_id").cast("string"), F.lit("4"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), tag)
    path = scratch(spark, "moves")
    formats.write_lines(e.repartitionByRange("vec_id").sortWithinPartitions("vec_id", "k").select(line.alias("value")), path)
    return formats.read_moves(spark, path).select("read_id", "stride", records.moved(F.col("moves")).alias("moved"))


@query("SELECT o_custkey::varchar AS chr, count(*) AS n, min(o_orderkey)::bigint AS first, sum(o_orderkey % 97)::bigint AS total FROM orders WHERE o_custkey % 5 = 0 GROUP BY o_custkey")
def index_tables(spark, d):
    """An index as TSV, read under other names of its columns."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("chr"), F.col("o_orderkey").alias("offset"), (F.col("o_orderkey") % 97).alias("length"))
    path = scratch(spark, "index")
    formats.write_tsv(o, path)
    read = formats.read_tsv(spark, path, {"chr": ("chrom", "chr"), "sig_offset": ("sig_offset", "offset"), "sig_len": ("sig_len", "length")})
    chosen = read.where(F.col("chr").cast("long") % 5 == 0).groupBy("chr")
    return chosen.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("sig_offset").cast("long")).alias("first"), F.sum(F.col("sig_len").cast("long")).alias("total"))


@query("SELECT p_partkey::varchar AS id, p_size::varchar AS size FROM part WHERE p_size % 2 = 0")
def spaced_columns(spark, d):
    """A table parted by white space."""
    p = table(spark, d, "part").select(F.concat(F.lit("  "), F.col("p_partkey").cast("string"), F.lit(" \t "), F.col("p_size").cast("string"), F.lit("  ")).alias("value"))
    path = scratch(spark, "columns")
    formats.write_lines(p, path)
    return formats.read_columns(spark, path, ["id", "size"]).where(F.col("size").cast("int") % 2 == 0)


@query(
    """SELECT l_partkey AS chr, l_orderkey % 50 AS region, min(o) AS sig_off, sum(n)::bigint AS sig_len, min(o) AS mv_off, sum(n)::bigint AS mv_len, count(*) AS count
    FROM (SELECT *, l_orderkey * 10 AS o, l_linenumber AS n FROM lineitem) GROUP BY ALL"""
)
def data_set(spark, d):
    """An index and its blocks, reads and references as a set of files; the blocks read back."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("chr"), (F.col("l_orderkey") % 50).alias("region"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("read_id"), (F.col("l_orderkey") * 10).alias("sig_offset"), F.col("l_linenumber").cast("long").alias("sig_len"))
    index = li.withColumn("mv_offset", F.col("sig_offset")).withColumn("mv_len", F.col("sig_len"))
    reads = li.select("chr", "region", "read_id", F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"))
    references = li.select("chr", "region").distinct().withColumn("hap", F.lit("hap1")).withColumn("seq", F.lit("ACGT"))
    path = scratch(spark, "set")
    formats.write_dataset(index, reads, references, path)
    blocks = formats.read_tsv(spark, f"{path}/region_blocks.tsv")
    return blocks.select(*(F.col(c).cast("long").alias(c) for c in blocks.columns))
