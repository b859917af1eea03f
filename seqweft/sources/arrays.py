"""Positional arrays: the values of array columns in plain binary files, one after the other in the rows' order, and an index of their places.

Written in two phases. Tasks write files of their own range of rows, and an index of them, under names of their attempt,
and report how many values they wrote; the commit adds these up to the place where each range begins and puts down one
manifest. A reader knows the files of the manifest alone, so what a failed or repeated task wrote is never seen.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, LongType

#: Bytes that are read at once; slices further apart are read alone.
SPAN = 8 << 20


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    rows: int
    sizes: dict[str, int]


def _open(path: str):
    return pa.fs.FileSystem.from_uri(path)


def manifest(path: str) -> dict:
    """arrays: column -> numpy type; parts: name, rows, sizes and base, the place of its first value, for each column."""
    files, root = _open(path)
    at = f"{root}/manifest.json"
    if files.get_file_info(at).type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(f"no arrays were written to {path}")
    with files.open_input_file(at) as f:
        return json.loads(f.read())


class ArraysWriter(DataSourceArrowWriter):
    def __init__(self, options, schema, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.arrays = {k: np.dtype(t).str for k, t in (x.split(":") for x in options["arrays"].split(","))}
        missing = [c for c in self.arrays if c not in schema.fieldNames()]
        if missing:
            raise ValueError(f"no columns {missing}")

    def write(self, iterator):
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        part, name = TaskContext.get().partitionId(), f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        sinks = {c: files.open_output_stream(f"{root}/{name}.{c}.bin") for c in self.arrays}
        sizes, rows, index = dict.fromkeys(self.arrays, 0), 0, None
        for b in iterator:
            columns = {n: b.column(i) for i, n in enumerate(b.schema.names) if n not in self.arrays}
            for c, kind in self.arrays.items():
                lists = b.column(b.schema.get_field_index(c))
                values = np.asarray(lists.flatten())
                kept = values.astype(kind)
                if not np.array_equal(kept, values):
                    raise ValueError(f"values of {c} do not fit {kind}")
                sinks[c].write(kept)
                size = lists.value_lengths().cast(pa.int64())
                known = np.asarray(size.fill_null(0))
                columns[f"{c}_offset"] = pa.array(sizes[c] + np.cumsum(known) - known)
                columns[f"{c}_len"] = size
                sizes[c] += len(values)
            table = pa.table(columns)
            index = index or pa.parquet.ParquetWriter(f"{root}/{name}.index.parquet", table.schema, filesystem=files, compression="zstd")
            index.write_table(table)
            rows += b.num_rows
        for s in (*sinks.values(), *([index] if index else [])):
            s.close()
        return Written(part, name, rows, sizes)

    def commit(self, messages):
        files, root = _open(self.path)
        base, parts = dict.fromkeys(self.arrays, 0), []
        for m in sorted((m for m in messages if m and m.rows), key=lambda m: m.part):
            parts.append({"name": m.name, "rows": m.rows, "sizes": m.sizes, "base": dict(base)})
            base = {c: n + m.sizes[c] for c, n in base.items()}
        there = files.get_file_info(f"{root}/manifest.json").type != pa.fs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} holds arrays")
        old = manifest(self.path)["parts"] if there else []
        with files.open_output_stream(f"{root}/.manifest") as f:
            f.write(json.dumps({"arrays": self.arrays, "parts": parts}).encode())
        files.move(f"{root}/.manifest", f"{root}/manifest.json")
        self._remove([p["name"] for p in old] + [m.name for m in messages if m and not m.rows])

    def abort(self, messages):
        self._remove([m.name for m in messages if m])

    def _remove(self, names: list[str]) -> None:
        files, root = _open(self.path)
        for info in files.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.split(".")[0] in names:
                files.delete_file(info.path)


@dataclass
class Part(InputPartition):
    number: int


_TESTS = {EqualTo: "==", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class ArraysReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.schema, self.tests, self.bytes_read = options["path"], schema, [], 0

    def pushFilters(self, filters):
        """Filters on key columns choose rows of the index; Spark applies them again."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], _TESTS[type(f)], list(f.value) if isinstance(f, In) else f.value))
            yield f

    def partitions(self):
        return [Part(i) for i in range(len(manifest(self.path)["parts"]))] or [Part(-1)]

    def _slices(self, root, files, name: str, column: str, kind: str, offset: np.ndarray, length: np.ndarray):
        """The values of rows that stand in order of their offsets, read in spans."""
        dtype, out = np.dtype(kind), []
        wide = dtype.itemsize
        with files.open_input_file(f"{root}/{name}.{column}.bin") as f:
            size, begin, span = f.size(), 0, b""
            for o, n in zip((offset * wide).tolist(), (length * wide).tolist(), strict=True):
                if o + n > size:
                    raise OSError(f"{name}.{column} ends before its values")
                if n and not begin <= o <= o + n <= begin + len(span):
                    ahead = int(np.searchsorted(offset * wide, o + SPAN, "right"))
                    last = int(np.max((offset * wide + length * wide)[len(out) : max(ahead, len(out) + 1)]))
                    dense = int(length[len(out) : ahead].sum()) * wide * 2 >= last - o
                    begin, span = o, f.read_at(last - o if dense else n, o)
                    self.bytes_read += len(span)
                out.append(np.frombuffer(span, dtype, n // wide, o - begin) if n else np.zeros(0, dtype))
        return out

    def read(self, part):
        if part.number < 0:
            return
        made = manifest(self.path)
        p = made["parts"][part.number]
        files, root = _open(self.path)
        index = pa.parquet.read_table(f"{root}/{p['name']}.index.parquet", filesystem=files, filters=self.tests or None)
        step = 2_000
        for at in range(0, len(index), step):
            rows = index.slice(at, step)
            columns = []
            for field in self.schema.fields:
                name = field.name
                if name in made["arrays"]:
                    offset, length = rows.column(f"{name}_offset").to_numpy(), rows.column(f"{name}_len")
                    values = self._slices(root, files, p["name"], name, made["arrays"][name], offset, length.fill_null(0).to_numpy())
                    ends = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)), mask=pa.array(length.is_null().to_numpy()))
                    kind = pa.float64() if np.dtype(made["arrays"][name]).kind == "f" else pa.int64()
                    columns.append(lists.cast(pa.list_(kind)))
                elif name.endswith("_offset") and name[:-7] in made["arrays"]:
                    columns.append(pa.array(rows.column(name).to_numpy() + p["base"][name[:-7]]))
                else:
                    columns.append(rows.column(name).combine_chunks())
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks == 1 else c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in self.schema.fields])


class PositionalArrays(DataSource):
    """spark.read.format("positional_arrays"): option path. Writing: options path and arrays, as column:numpy type with commas."""

    @classmethod
    def name(cls):
        return "positional_arrays"

    def schema(self):
        path = self.options["path"]
        made = manifest(path)
        from pyspark.sql.pandas.types import from_arrow_schema

        if not made["parts"]:
            raise ValueError(f"{path} holds no rows; give a schema")
        files, root = _open(path)
        fields = from_arrow_schema(pa.parquet.read_schema(f"{root}/{made['parts'][0]['name']}.index.parquet", filesystem=files))
        for c, kind in made["arrays"].items():
            fields = fields.add(c, ArrayType(DoubleType() if np.dtype(kind).kind == "f" else LongType()))
        return fields

    def reader(self, schema):
        return ArraysReader(self.options, schema)

    def writer(self, schema, overwrite):
        return ArraysWriter(self.options, schema, overwrite)


def write_arrays(df: DataFrame, path: str, arrays: dict[str, str], order: list[str], parts: int | None = None) -> None:
    """Writes df with its array columns (column -> numpy type, as "i2") as positional arrays in the order of its rows by `order`.

    Values that do not fit their type are an error, nulls in an array too; a null array is null again when read, an empty one
    empty. What stood in path goes when the new rows stand. A task holds one batch and writes one file a column, `parts` in all.
    """
    spark = df.sparkSession
    spark.dataSource.register(PositionalArrays)
    rows = (df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    kinds = ",".join(f"{c}:{t}" for c, t in arrays.items())
    rows.write.format("positional_arrays").option("path", path).option("arrays", kinds).mode("overwrite").save()


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_arrays(), with <column>_offset and <column>_len: where each array stands in the whole.

    A filter on key columns reads the slices of the rows that it leaves.
    """
    spark.dataSource.register(PositionalArrays)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("positional_arrays").option("path", path).load()


def read_range(path: str, column: str, begin: int, end: int) -> np.ndarray:
    """Values [begin, end) of a column over all parts, as if it were one memory-mapped array."""
    made = manifest(path)
    files, root = _open(path)
    kind = np.dtype(made["arrays"][column])
    out = [np.zeros(0, kind)]
    for p in made["parts"]:
        lo, hi = max(begin, p["base"][column]), min(end, p["base"][column] + p["sizes"][column])
        if lo < hi:
            with files.open_input_file(f"{root}/{p['name']}.{column}.bin") as f:
                out.append(np.frombuffer(f.read_at((hi - lo) * kind.itemsize, (lo - p["base"][column]) * kind.itemsize), kind))
    return np.concatenate(out)


def array_gaps(spark: SparkSession, path: str) -> DataFrame:
    """(name, column, problem) of parts whose slices leave gaps, overlap, or do not end with their file; no rows if all is well."""
    made = manifest(path)
    files, root = _open(path)
    out = None
    for c, kind in made["arrays"].items():
        known = [(p["name"], p["sizes"][c], files.get_file_info(f"{root}/{p['name']}.{c}.bin").size // np.dtype(kind).itemsize) for p in made["parts"]]
        parts = spark.createDataFrame(known, "name string, values_ long, file_values long")
        sums = None
        if known:
            index = spark.read.parquet(*[f"{path}/{n}.index.parquet" for n, _, _ in known])
            name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.index\.parquet$", 1)
            n = F.coalesce(f"{c}_len", F.lit(0))
            # slices in order without gaps: ends are the running sums of lengths, so sums over both agree as sets
            sums = index.select(name.alias("name"), F.col(f"{c}_offset").alias("o"), (F.col(f"{c}_offset") + n).alias("e"), n.alias("n")).where("n > 0")
            sums = sums.groupBy("name").agg(F.sum("n").alias("covered"), F.min("o").alias("first"), F.max("e").alias("last"), F.count_distinct("o").alias("starts"), F.count(F.lit(1)).alias("rows"))
        checked = parts.join(sums, "name", "left") if sums is not None else parts.limit(0).select("name", "values_", "file_values", *(F.lit(0).alias(x) for x in ("covered", "first", "last", "starts", "rows")))
        problem = F.when(F.col("values_") != F.col("file_values"), "file").when(F.col("values_") == 0, None).when((F.col("first") != 0) | (F.col("last") != F.col("values_")) | (F.col("covered") != F.col("values_")) | (F.col("starts") != F.col("rows")), "slices")
        found = checked.select("name", F.lit(c).alias("column"), problem.alias("problem")).where("problem is not null")
        out = found if out is None else out.unionByName(found)
    return out
