"""Sorted SAM text with a side index: a data source whose partitions are the byte ranges that a query's contigs and places leave.

The index is a small Parquet table with a row for each block of lines of one contig: where it stands, its first and last
place and how far its reads go. Filters on chrom, pos and end reach the source, which reads the index's matching rows
and then those ranges alone. Within a range reading ends at the first row behind the places asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.sequence import parse_cigar

#: Bytes of a block of the index, of a partition, and of one read.
BLOCK, SPLIT, CHUNK = 1 << 18, 32 << 20, 1 << 18

_COLUMNS = "path string, block long, qname string, flag int, chrom string, pos long, end long, mapq int, cigar string, seq string, qual string, tags array<string>"
_OPS = re.compile(rb"(\d+)([MIDNSHP=X])")


def reference_end(pos: int, cigar: bytes) -> int:
    """The 0-based place behind a read's last reference letter; a read without a cigar takes one place."""
    return pos + (sum(int(n) for n, op in _OPS.findall(cigar) if op in b"MDN=X") or 1)


class Lines:
    """Lines of a file, with their ends, that begin in [begin, end), read in chunks; counts the bytes that were read."""

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end, self.read = path, begin, end, 0

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        files, name = pa.fs.FileSystem.from_uri(self.path)
        with files.open_input_file(name) as f:
            size = f.size()
            # a line that begins before the range is another range's: start at the letter before, and skip what it ends
            at = self.begin - 1 if self.begin else 0
            held, skip = b"", bool(self.begin)
            while at < size:
                want = min(CHUNK, size - at, self.end - at if at < self.end else CHUNK)
                data = f.read_at(want, at)
                self.read += len(data)
                at += len(data)
                whole = held + data
                start = at - len(whole)
                cut = whole.rfind(b"\n") + 1 if at < size else len(whole)
                for line in whole[:cut].splitlines(True):
                    if skip:
                        skip = False
                    elif start >= self.end:
                        return
                    else:
                        yield start, line
                    start += len(line)
                held = whole[cut:]
                if start >= self.end:
                    return


def _blocks(path: str, begin: int, end: int, block: int):
    """(path, offset, length, chrom, first, last, reach, rows) of blocks of lines; an error where places go back."""
    now = None
    for at, line in Lines(path, begin, end):
        f = line.split(b"\t", 6)
        if line.startswith(b"@") or len(f) < 7:
            if now:
                yield now
            now = None
            continue
        chrom, pos = f[2].decode(), int(f[3]) - 1
        if now and now[3] == chrom and pos < now[5]:
            raise ValueError(f"{path} is not sorted: {chrom}:{pos + 1} at byte {at} comes after {now[5] + 1}")
        if now and (now[3] != chrom or at - now[1] >= block):
            yield now
            now = None
        if now is None:
            now = [path, at, 0, chrom, pos, pos, 0, 0]
        now[2], now[5] = at + len(line) - now[1], pos
        now[6], now[7] = max(now[6], reference_end(pos, f[5])), now[7] + 1
    if now:
        yield now


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(f.getPath().toString(), f.getLen()) for f in system.globStatus(where) or [] if f.isFile()]
    if not found:
        found = [(f.getPath().toString(), f.getLen()) for f in system.listStatus(where)]
    found = sorted((p, n) for p, n in found if n and not p.rsplit("/", 1)[-1].startswith(("_", ".")))
    if any(p.endswith((".gz", ".bz2", ".zst")) for p, _ in found):
        raise ValueError("compressed files have no byte ranges; write them as plain text")
    return found


def index_sam(spark: SparkSession, path: str, index: str | None = None, block: int = BLOCK, split: int = SPLIT, header: bool = True) -> str:
    """Writes the side index of sorted SAM text, a file or a folder of files each sorted by contig and place, and returns its path.

    By default it stands beside the file as <path>.index. Ranges of all files are read by tasks of their own. Places that go
    back, contigs that come again in a file, and with header a file without header lines are errors.
    """
    index = index or f"{path.rstrip('/')}.index"
    files = _files(spark, path)
    ranges = [(p, at, min(at + split, n)) for p, n in files for at in range(0, n, split)]
    schema = "path string, offset long, length long, chrom string, first long, last long, reach long, rows long"

    def work(batches):
        for b in batches:
            for path, begin, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if header and not begin and not next(iter(Lines(path, 0, 1)), (0, b""))[1].startswith(b"@"):
                    raise ValueError(f"{path} has no header")
                rows = list(_blocks(path, begin, end, block))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    arrow = pa.schema([(n, pa.string() if n in ("path", "chrom") else pa.int64()) for n in ("path", "offset", "length", "chrom", "first", "last", "reach", "rows")])
    names = arrow.names
    todo = spark.createDataFrame(ranges, "path string, begin long, end long").repartition(max(1, len(ranges)))
    found = todo.mapInArrow(work, schema)
    found.repartitionByRange("chrom", "first").sortWithinPartitions("chrom", "first").write.mode("overwrite").parquet(index)
    turns = spark.read.schema(schema).parquet(index).groupBy("path", "chrom").agg(F.min("offset").alias("a"), F.max(F.col("offset") + F.col("length")).alias("z"), F.sum("length").alias("bytes"))
    broken = turns.where("z - a <> bytes").first()
    if broken:
        raise ValueError(f"{broken['chrom']} comes more than once in {broken['path']}, or lines stand between its rows")
    return index


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


class SortedSamReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.index = options.get("index", f"{self.path.rstrip('/')}.index")
        self.split = int(options.get("split", SPLIT))
        self.only = options["contigs"].split(",") if options.get("contigs") else None
        self.ranges = options.get("ranges")
        self.contigs: set[str] | None = None
        self.least: dict[str, int] = {}  # smallest values of pos and end that are asked for
        self.most: dict[str, int] = {}
        self.bytes_read = 0

    def pushFilters(self, filters):
        """Takes what prunes ranges; Spark applies all filters to the rows again."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "chrom" and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.contigs = asked if self.contigs is None else self.contigs & asked
            elif column in ("pos", "end"):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.least[column] = max(self.least.get(column, f.value), f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.most[column] = min(self.most.get(column, f.value), f.value - isinstance(f, LessThan))
            yield f

    def _reached(self):
        """Rows of the index that can hold what is asked for."""
        tests = []
        if self.contigs is not None:
            tests.append(("chrom", "in", sorted(self.contigs)))
        tests += [(c, ">=", self.least[k]) for k, c in (("pos", "last"), ("end", "reach")) if k in self.least]
        tests += [("first", "<=", x) for k, x in self.most.items()]  # a read's end lies behind its place
        files, name = pa.fs.FileSystem.from_uri(self.index)
        if files.get_file_info(name).type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(f"no index at {self.index}; index_sam() writes it")
        if self.contigs is not None and not self.contigs:
            return []
        return pa.parquet.read_table(name, filesystem=files, filters=tests or None, columns=["path", "offset", "length"]).to_pylist()

    def partitions(self):
        if self.ranges:  # without an index: all ranges of the files
            return [Range(p, int(a), int(z)) for p, a, z in (x.rsplit(":", 2) for x in self.ranges.split("\n"))]
        out: list[Range] = []
        for b in sorted(self._reached(), key=lambda b: (b["path"], b["offset"])):
            last = out[-1] if out else None
            if last and last.path == b["path"] and last.end == b["offset"] and b["offset"] + b["length"] - last.begin <= self.split:
                last.end = b["offset"] + b["length"]
            else:
                out.append(Range(b["path"], b["offset"], b["offset"] + b["length"]))
        return out or [Range("", 0, 0)]

    def read(self, part):
        lines, rows = Lines(part.path, part.begin, part.end), []
        upto = min(self.most.values(), default=None)
        for _, line in lines if part.end else ():
            f = line.decode().rstrip("\r\n").split("\t", 11)
            if line.startswith(b"@") or len(f) < 11:
                continue
            chrom, pos = f[2], int(f[3]) - 1
            if self.only is not None and chrom not in self.only:
                break  # files are sorted, the contigs asked for come first: no later row is one of theirs
            if upto is not None and pos > upto and self.contigs is not None and len(self.contigs) == 1 and chrom in self.contigs:
                break
            rows.append((part.path, part.begin, f[0], int(f[1]), chrom, pos, reference_end(pos, f[5].encode()), int(f[4]), f[5], f[9], f[10], f[11].split("\t") if len(f) > 11 else []))
            if len(rows) == 10_000:
                yield _batch(rows)
                rows = []
        self.bytes_read += lines.read
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([
    ("path", pa.string()), ("block", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("end", pa.int64()),
    ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.list_(pa.string())),
])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class SortedSam(DataSource):
    """spark.read.format("sorted_sam"): options path, index, split; contigs and ranges are set by scan_until()."""

    @classmethod
    def name(cls):
        return "sorted_sam"

    def schema(self):
        return _COLUMNS

    def reader(self, schema):
        return SortedSamReader(self.options)


def _enable(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets filters reach it."""
    spark.dataSource.register(SortedSam)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_indexed_sam(spark: SparkSession, path: str, index: str | None = None, split: int = SPLIT) -> DataFrame:
    """(path, block, qname, flag, chrom, pos, end, mapq, cigar, seq, qual, tags) of indexed SAM text; pos and end are 0-based, end behind the last letter.

    A filter on chrom, pos or end reads the byte ranges of the index's blocks that can hold its rows. A missing index is
    an error. block is where a row's range begins.
    """
    _enable(spark)
    rows = spark.read.format("sorted_sam").option("path", path).option("split", split)
    return (rows.option("index", index) if index else rows).load()


def region_scan(spark: SparkSession, path: str, chrom: str, begin: int, end: int, index: str | None = None) -> DataFrame:
    """read_indexed_sam() rows that overlap [begin, end) of a contig, 0-based, with cigar as array<struct<op, len>>."""
    rows = read_indexed_sam(spark, path, index).where((F.col("chrom") == chrom) & (F.col("pos") < end) & (F.col("end") > begin))
    return rows.withColumn("cigar", parse_cigar(F.col("cigar")))


def scan_until(spark: SparkSession, path: str, contigs: list[str], split: int = SPLIT) -> DataFrame:
    """Rows of the contigs that stand first in sorted SAM text, without an index: each range ends at its first row of another contig.

    Of ranges behind those contigs one chunk is read. Equals a filter on chrom where the contigs come before all others.
    """
    _enable(spark)
    ranges = "\n".join(f"{p}:{at}:{min(at + split, n)}" for p, n in _files(spark, path) for at in range(0, n, split))
    rows = spark.read.format("sorted_sam").option("path", path).option("contigs", ",".join(contigs)).option("ranges", ranges)
    return rows.load()


def write_sorted_sam(rows: DataFrame, path: str) -> None:
    """Rows (qname, flag, chrom, pos 0-based, mapq, cigar, seq, qual) as SAM text without header, sorted by contig and place over all parts."""
    line = F.concat_ws("\t", "qname", F.col("flag").cast("string"), "chrom", (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", "qual")
    rows.repartitionByRange("chrom", "pos", "qname").sortWithinPartitions("chrom", "pos", "qname").select(line.alias("value")).write.mode("overwrite").text(path)
