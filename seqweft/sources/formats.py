"""FASTA, FASTQ, VCF, SAM text and TSV as DataFrames and back. All are read by splits, so one large file is many tasks (.gz files are one each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import parse_cigar
from ..operators.records import last_wins, region_blocks


def _pieces(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """(path, block, row, value): parts of text files between separators; block is where the split begins, row rises within it."""
    rows = spark.read.text(path, lineSep=separator)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")


def _stop(message: str, path: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), path)).cast("boolean")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, row, name, header, seq), in a file's order by block and row; blank lines do not count.

    Records are what stands between line ends with > behind them. Text before a file's first record is an error.
    """
    rows = _pieces(spark, path, "\n>")
    # a split that begins inside a file begins behind a separator, so only a file's first part has its own >
    begins = rows.where("block = 0").groupBy("path").agg(F.min("row").alias("row"))
    begins = begins.select("path", "row", F.lit(True).alias("first_"))
    rows = rows.where(F.regexp_replace("value", r"\s", "") != "").join(begins, ["path", "row"], "left")
    ok = F.when(F.col("first_") & ~F.startswith(F.ltrim("value"), F.lit(">")), _stop("text before the first record of ", F.col("path"))).otherwise(True)
    rows = rows.where(ok)
    value = F.regexp_replace("value", r"^\s*>", "")
    lines = F.transform(F.split(value, "\n"), lambda x: F.trim(F.regexp_replace(x, "\r", "")))
    header = F.get(lines, F.lit(0))
    seq = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "")
    return rows.select("path", "block", "row", F.get(F.split(header, r"\s+"), F.lit(0)).alias("name"), header.alias("header"), seq.alias("seq"))


def read_fastq(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, pos, read_id, header, seq, qual), pos counts a file's records from 0.

    With strict, a bad header or separator or a cut record is an error, else such a record ends the file. Lines are
    counted by split first, which gives each its number in the file; a record's four lines then meet by that number.
    """
    lines = _pieces(spark, path)
    blocks = lines.groupBy("path", "block").agg(F.min("row").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", "first_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    number = F.col("before_") + F.col("row") - F.col("first_")
    numbered = lines.join(blocks, ["path", "block"]).select("path", F.floor(number / 4).alias("pos"), (number % 4).alias("k"), F.regexp_replace("value", "\r$", "").alias("value"))
    line = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    records = numbered.groupBy("path", "pos").agg(*(line(k).alias(f"l{k}") for k in range(4)))
    ok = F.startswith("l0", F.lit("@")) & F.col("l2").rlike(r"^(\+|$)") & F.col("l3").isNotNull()
    blank = F.concat_ws("", "l0", "l1", "l2", "l3") == ""
    records = records.withColumn("ok_", F.coalesce(ok, F.lit(False))).where(F.col("ok_") | ~blank if strict else F.lit(True))
    if strict:
        records = records.where(F.when(F.col("ok_"), True).otherwise(_stop("bad record in ", F.col("path"))))
    else:
        ends = records.where("not ok_").groupBy("path").agg(F.min("pos").alias("end_"))
        records = records.join(ends, "path", "left").where("end_ is null or pos < end_")
    header = F.substring("l0", 2, 1 << 30)
    return records.select("path", "pos", F.get(F.split(header, " "), F.lit(0)).alias("read_id"), header.alias("header"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))


def fastq_lengths(reads: DataFrame) -> DataFrame:
    """(read_id, length) of reads of which no line is empty."""
    return reads.where("seq <> '' and qual <> '' and header <> ''").select("read_id", F.length("seq").alias("length"))


def fasta_lengths(records: DataFrame) -> DataFrame:
    """(path, name, length) of records with letters."""
    return records.select("path", "name", F.length("seq").alias("length")).where("length > 0")


def resolve(spark: SparkSession, folder: str, patterns: tuple[str, ...]) -> str | None:
    """The one file that the first pattern with a match matches; several are an error, none gives None."""
    jvm = spark._jvm
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{p}")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        if len(found) > 1:
            raise ValueError(f"{len(found)} files match {p} in {folder}")
        if len(found):
            return found[0].getPath().toString()
    return None


def segments(spark: SparkSession, root: str, marker: str) -> DataFrame:
    """(segment): folders under root, itself included, that hold the marker file, each once, in order. The names are listed by Spark's tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", marker).load(root)
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("segment")).distinct().orderBy("segment")


def slices(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """regions (chrom, start, end, ...), 1-based closed, with seq: that part of the contig (name, seq), upper case; cut at its ends, null for an unknown contig."""
    a = F.greatest(F.col("start"), F.lit(1))
    c = contigs.select(F.col("name").alias("chrom"), F.col("seq").alias("contig_"))
    seq = F.upper(F.substring("contig_", a.cast("int"), F.greatest(F.col("end") - a + 1, F.lit(0)).cast("int")))
    return regions.join(c, "chrom", "left").withColumn("seq", seq).drop("contig_")


def read_columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A table parted by white space, as strings; blank lines are dropped, and a line with another number of columns is an error."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''")
    rows = rows.where(F.when(F.size(f) == len(names), True).otherwise(_stop(f"not {len(names)} columns: ", F.col("value"))))
    return rows.select(*(F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alt, format, sample) of lines with ten columns at least; .gz too."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("not startswith(value, '#')").where(F.size(f) >= 10)
    return rows.select(f[0].alias("chrom"), f[1].try_cast("int").alias("pos"), f[3].alias("ref"), f[4].alias("alt"), f[8].alias("format"), f[9].alias("sample")).where("pos is not null")


def read_vcf_samples(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alt, format, sample, call) for each sample column of each line; sample is its name in the file's #CHROM line.

    A file with calls but without that line, or a line with more calls than names, is an error.
    """
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value", F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))).alias("calls"))
    names = rows.where("startswith(value, '#CHROM')").groupBy("path").agg(F.first("calls").alias("names"))
    rows = rows.where("not startswith(value, '#')").where(F.size("calls") > 0).join(names, "path", "left")
    rows = rows.where(F.when(F.coalesce(F.size("names"), F.lit(0)) >= F.size("calls"), True).otherwise(_stop("calls without a sample's name in ", F.col("path"))))
    each = rows.select("value", F.posexplode("calls").alias("at", "call"), "names")
    return each.select(f[0].alias("chrom"), f[1].try_cast("int").alias("pos"), f[3].alias("ref"), f[4].alias("alt"), f[8].alias("format"), F.get("names", F.col("at")).alias("sample"), "call").where("pos is not null")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, row, qname, flag, chrom, pos 0-based, mapq, cigar, seq, qual, tags) of SAM text; a file's order is by block and row."""
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = _pieces(spark, path).where("not startswith(value, '@')").where(F.size(f) >= 11)
    return rows.select(
        "path", "block", "row", f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("chrom"), (f[3].cast("long") - 1).alias("pos"), f[4].cast("int").alias("mapq"),
        parse_cigar(f[5]).alias("cigar"), f[9].alias("seq"), f[10].alias("qual"), F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))).alias("tags"),
    )


def read_moves(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, stride, moves) of the mv:B:c tags of SAM text; of several records of a read the last counts, whatever their flags."""
    tag = F.get(F.filter("tags", lambda t: F.startswith(t, F.lit("mv:B:c,"))), F.lit(0))
    numbers = F.transform(F.split(F.substring(tag, 8, 1 << 30), ","), lambda x: x.try_cast("int"))
    rows = read_sam(spark, path).select(F.col("qname").alias("read_id"), "path", "block", "row", numbers.alias("n")).where("n is not null")
    rows = rows.select("read_id", "path", "block", "row", F.get("n", F.lit(0)).alias("stride"), F.slice("n", 2, F.greatest(F.size("n") - 1, F.lit(0))).alias("moves"))
    return last_wins(rows, "read_id", ["path", "block", "row"]).select("read_id", "stride", "moves")


def read_tsv(spark: SparkSession, path: str, names: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A tab-separated table with a header; names: column -> the names under which files have it, of which the first found is taken."""
    df = spark.read.csv(path, sep="\t", header=True)
    if not names:
        return df
    out = []
    for name, found in names.items():
        have = next((c for c in found if c in df.columns), None)
        if have is None:
            raise KeyError(f"none of {found} in {df.columns}")
        out.append(F.col(have).alias(name))
    return df.select(*out)


def fasta_lines(df: DataFrame, header: str, seq: str, width: int = 60) -> DataFrame:
    wrapped = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), wrapped).alias("value"))


def fastq_lines(df: DataFrame, header: str, seq: str, qual: str) -> DataFrame:
    return df.select(F.concat(F.lit("@"), F.col(header), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(qual)).alias("value"))


def write_lines(lines: DataFrame, path: str, by: str | None = None) -> None:
    """Text files, one folder for each value of `by`; Spark's commit makes them appear at once."""
    w = lines.write.mode("overwrite")
    (w.partitionBy(by) if by else w).text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_dataset(index: DataFrame, reads: DataFrame, references: DataFrame, path: str) -> None:
    """index.tsv, region_blocks.tsv, reads.fastq and refs.fasta under a folder, sorted by chromosome and region over all their parts.

    index: chr, region, read_id, sig_offset, sig_len, mv_offset, mv_len and more; reads: chr, region, read_id, seq, qual;
    references: chr, region, hap, seq, of which hap1 comes first, then hap2, then others.
    """
    write_tsv(index.orderBy("chr", "region", "sig_offset"), f"{path}/index.tsv")
    write_tsv(region_blocks(index).orderBy("chr", "region"), f"{path}/region_blocks.tsv")
    write_lines(fastq_lines(reads.orderBy("chr", "region", "read_id"), "read_id", "seq", "qual"), f"{path}/reads.fastq")
    place = F.when(F.col("hap") == "hap1", 1).when(F.col("hap") == "hap2", 2).otherwise(3)
    named = references.orderBy("chr", "region", place, "hap").select(F.concat_ws("_", "region", "hap").alias("name"), "seq")
    write_lines(fasta_lines(named, "name", "seq"), f"{path}/refs.fasta")
