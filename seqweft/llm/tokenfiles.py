"""Token ids in raw binary files, with a minimal perfect hash index from document keys to their places.

Documents are dealt by ranges of their ids, so tasks write whole files of ids (little-endian unsigned integers, of 16
bits if the vocabulary allows it, else of 32) in ascending order. A file's name has its attempt's own mark; which files count is said by the table of places, which
Spark commits, so what a lost or repeated task leaves behind is never read, and goes when the table stands.

The index deals keys to buckets of about KEYS keys. In a bucket, levels of bits take the keys that meet no other one
there and hand on the rest; the number of bits before a key's own bit is its slot, so n keys have n slots. A slot holds
a fingerprint of the key, the file's number, and the place and number of the ids. A key that was never written is told
by its fingerprint, but for one in 2^32.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import _path, discard, row_keys, shared_dir, stash, string_array, whole_groups
from .textscan import mix

#: Keys of a bucket on average, bits for each key of a level, ids of a file before the next one begins, bytes read at once.
KEYS, GAMMA, SHARD, SPAN = 1_000, 2, 16 << 20, 16 << 20


class ByteCoder:
    """A byte-level tokenizer file run by tiktoken's merge loop, several times as fast as the file's own library, with the same ids.

    Special tokens' strings are special tokens, as in the library's default. Texts with white space that only some
    libraries know, and words with characters beyond Latin letters, whose classes differ between versions of Unicode,
    go to the library itself.
    """

    #: The file's pattern (a fixed value of the public tokenizers).
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import json

        from tiktoken import Encoding
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        if len(set(made)) < len(made):
            raise ValueError("two merges make one token; the loop takes a token's rank for that of its merge")
        tokens = [t for t in letters if t in vocab] + made  # their places are the loop's ranks
        self.ids = np.array([vocab[t] for t in tokens], "<u4")
        self.merge = Encoding("bytes", pat_str=self.PATTERN, mergeable_ranks={bytes(letters[c] for c in t): i for i, t in enumerate(tokens)}, special_tokens={}).encode_ordinary
        self.largest = max([*vocab.values(), *self.special.values()])
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.unlike = re.compile("[\x1c-\x1f\x85᠎]").search
        self.far = re.compile("[^\x00-ɏ]").search
        self.words = re.compile(r"(?<=\S)(?= \S)").split  # where a single space begins a piece of the pattern

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        if not self.far(text):
            return self.ids[self.merge(text)].tobytes()
        out, held = [], []
        for word in self.words(text):
            if self.far(word):
                out += [self.ids[self.merge("".join(held))].tobytes(), self._whole(word)]
                held = []
            else:
                held.append(word)
        return b"".join([*out, self.ids[self.merge("".join(held))].tobytes()])

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if self.unlike(text):
            return self._whole(text)
        if not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(array("I", [self.special[s]]).tobytes() if s in self.special else self._plain(s) for s in self.at_special.split(text) if s)


_coders: dict[str, ByteCoder] = {}


def byte_coder(path: str) -> ByteCoder:
    """The process's own coder: a worker reads the vocabulary once for all its tasks."""
    if path not in _coders:
        _coders[path] = ByteCoder(path)
    return _coders[path]


def _write(batches, folder: str, path: str, end: bytes, most: int, width: int):
    """Writes the rows' ids to files of this task, a next one after `most` ids, and gives their places."""
    files, root = pa.fs.FileSystem.from_uri(folder)
    coder, task, mark = byte_coder(path), TaskContext.get().partitionId(), uuid.uuid4().hex
    number, sink, at = -1, None, 0
    try:
        for b in batches:
            texts = string_array(b.column("text")).to_pylist()
            for lo in range(0, len(texts), 1_000):
                shard, first, size = [], [], []
                for text in texts[lo : lo + 1_000]:
                    if sink is None or at >= most:
                        if sink:
                            sink.close()
                        number, at = number + 1, 0
                        sink = files.open_output_stream(f"{root}/ids-{task}-{number}-{mark}")
                    code = coder.encode(text) + end
                    sink.write(code if width == 4 else np.frombuffer(code, "<u4").astype("<u2"))
                    shard.append(number)
                    first.append(at)
                    size.append(len(code) // 4)
                    at += len(code) // 4
                names = [f"ids-{task}-{k}-{mark}" for k in shard]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(lo, len(shard)), b.column("name").slice(lo, len(shard)), pa.array([task << 32 | k for k in shard], pa.int64()),
                        pa.array(names), pa.array(first, pa.int64()), pa.array(size, pa.int64()),
                    ],
                    ["doc_id", "name", "shard", "file", "first", "n"],
                )
    finally:
        if sink:
            sink.close()


def _halves(digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit halves of 16-byte keys."""
    both = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _spot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(a ^ mix(b + np.uint64(level))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """n keys of 128 bits, all different, to the numbers 0 to n - 1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        """bits: one word of 64 bits after the other, level by level; sizes: bits of each level, multiples of 64."""
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @staticmethod
    def build(a: np.ndarray, b: np.ndarray) -> PerfectHash:
        if len(a) and len(np.unique(np.stack([a, b], 1), axis=0)) < len(a):
            raise ValueError("two keys share their 128-bit digest")
        sizes, levels = [], []
        while len(a):
            size = -(-GAMMA * len(a) // 64) * 64
            spot = _spot(a, b, len(sizes), size)
            alone = np.bincount(spot, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = ~alone[spot]
            a, b = a[rest], b[rest]
        return PerfectHash(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each key's number; of keys that were not built in, any number or -1."""
        out = np.full(len(a), -1, np.int64)
        todo, base = np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            spot = base + _spot(a[todo], b[todo], level, size)
            word, bit = spot >> 6, (spot & 63).astype(np.uint64)
            here = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[here]] = self.before[word[here]] + np.bitwise_count(below[here])
            todo, base = todo[~here], base + size
        return out


class Bucket:
    """A perfect hash with its slots: (fingerprint, shard, first, n); kept as one string of bytes."""

    def __init__(self, hashed: PerfectHash, prints: np.ndarray, slots: np.ndarray):
        self.hashed, self.prints, self.slots = hashed, prints, slots

    @staticmethod
    def build(digests: pa.Array, slots: np.ndarray) -> Bucket:
        """slots: rows (shard, first, n) of the keys."""
        a, b = _halves(digests)
        hashed = PerfectHash.build(a, b)
        at = hashed.find(a, b)
        prints, placed = np.zeros(len(a), "<u4"), np.zeros((len(a), 3), "<i8")
        prints[at], placed[at] = b >> np.uint64(32), slots
        return Bucket(hashed, prints, placed)

    def find(self, digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(whether the key is there, its slot)."""
        a, b = _halves(digests)
        at = self.hashed.find(a, b)
        known = at >= 0
        known[known] = self.prints[at[known]] == b[known] >> np.uint64(32)
        return known, self.slots[np.where(known, at, 0)] if len(self.slots) else np.zeros((len(a), 3), np.int64)

    def pack(self) -> bytes:
        head = np.array([len(self.hashed.sizes), *self.hashed.sizes, len(self.prints)], "<i8")
        return head.tobytes() + self.hashed.bits.tobytes() + self.slots.tobytes() + self.prints.tobytes()

    @staticmethod
    def unpack(data: bytes) -> Bucket:
        levels = int(np.frombuffer(data, "<i8", 1)[0])
        *sizes, n = np.frombuffer(data, "<i8", levels + 1, 8).tolist()
        at = 8 * (levels + 2)
        bits = np.frombuffer(data, "<u8", sum(sizes) // 64, at)
        at += 8 * len(bits)
        return Bucket(PerfectHash(sizes, bits), np.frombuffer(data, "<u4", n, at + 24 * n), np.frombuffer(data, "<i8", 3 * n, at).reshape(n, 3))


def _build(batches):
    """(bucket, data): the packed index of each bucket."""
    for table in whole_groups(batches, "bucket"):
        table = table.combine_chunks()
        bucket, digest = np.asarray(table.column("bucket").chunk(0)), table.column("digest").chunk(0)
        slots = np.stack([np.asarray(table.column(c).chunk(0)) for c in ("shard", "first", "n")], 1)
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        made = [Bucket.build(digest.slice(s, e - s), slots[s:e]).pack() for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(made, pa.binary())], ["bucket", "data"])


def _probe(batches):
    """Rows of a bucket, its index before the keys that are asked for: doc_id, shard, first, n of each key, nulls for unknown ones."""
    at, index = None, None
    for b in batches:
        bucket = np.asarray(b.column("bucket"))
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if bucket[s] != at:
                at, index = bucket[s], None
            data = b.column("data")[s].as_py()
            if data is not None:
                index, s = Bucket.unpack(data), s + 1
            if s == e:
                continue
            known, slot = index.find(b.column("digest").slice(s, e - s)) if index else (np.zeros(e - s, bool), np.zeros((e - s, 3), np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s, e - s), *(pa.array(slot[:, k], pa.int64(), mask=~known) for k in range(3))], ["doc_id", "shard", "first", "n"])


def _read(batches, folder: str, width: int, with_ids: bool):
    """Of rows (doc_id, start, file, first, n) by file and place: doc_id, start, n_tokens, ids_crc32 and the ids, read in long spans."""
    files, root = pa.fs.FileSystem.from_uri(folder)
    name, source, span, begin = None, None, b"", 0
    for b in batches:
        crc, ids = [], []
        for file, first, n in zip(b.column("file").to_pylist(), b.column("first").to_pylist(), b.column("n").to_pylist(), strict=True):
            if file is None:
                crc.append(None)
                ids.append(None)
                continue
            if file != name:
                if source:
                    source.close()
                name, source, span, begin = file, files.open_input_file(f"{root}/{file}"), b"", 0
            s, e = width * first - begin, width * (first + n) - begin
            if s < 0 or e > len(span):
                begin = width * first
                span = source.read_at(max(width * n, min(SPAN, source.size() - begin)), begin)
                s, e = 0, width * n
            if e > len(span):
                raise OSError(f"{file} ends before its document's ids")
            code = np.frombuffer(span, f"<u{width}", n, s).astype("<u4", copy=False)
            crc.append(zlib.crc32(code))
            if with_ids:
                ids.append(code.astype(np.int64))
        cols = [b.column("doc_id"), b.column("start"), b.column("n"), pa.array(crc, pa.int64())]
        if with_ids:
            cols.append(pa.array(ids, pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
    if source:
        source.close()


def _bucket(name: Column, buckets: int) -> Column:
    return (F.crc32(name.cast("binary")) % buckets).cast("long")


def _digest(name: Column) -> Column:
    return F.unhex(F.md5(name))


@dataclass
class TokenFiles:
    """Files of ids of `width` bytes each in `folder`, and tables: places (doc_id, name, shard, file, first, n), shards (shard, file, base), index (bucket, data)."""

    folder: str
    places: DataFrame
    shards: DataFrame
    index: DataFrame
    buckets: int
    width: int

    def lookup(self, keys: DataFrame, id_col: str = "doc_id", name_col: str | None = None, with_ids: bool = False) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 and, with_ids, ids of each row of keys, found by the index and read from the files; nulls for unknown keys.

        Keys are ids, or names as in places where ids repeat or lack (see write_tokens). Rows that ask for one key
        many times stream through the task that holds its bucket.
        """
        name = F.col(name_col) if name_col else F.col(id_col).cast("string")
        asked = keys.select(_bucket(F.coalesce(name, F.lit("")), self.buckets).alias("bucket"), F.lit(None).cast("binary").alias("data"), F.col(id_col).alias("doc_id"), _digest(F.coalesce(name, F.lit(""))).alias("digest"))
        kind = dict(asked.dtypes)["doc_id"]
        held = self.index.select("bucket", "data", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("binary").alias("digest"))
        both = held.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", F.col("data").isNull())
        found = both.mapInArrow(_probe, f"doc_id {kind}, shard long, first long, n long").join(self.shards, "shard", "left")
        found = found.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "shard", "file", "first", "n")
        found = found.repartition("shard").sortWithinPartitions("shard", "first").drop("shard")
        folder, width = self.folder, self.width
        schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
        return found.mapInArrow(lambda it: _read(it, folder, width, with_ids), schema)

    def get(self, key) -> list[int] | None:
        """The ids of one document, by one row of the index and one read; None for an unknown key."""
        name = str(key).encode()
        row = self.index.where(F.col("bucket") == zlib.crc32(name) % self.buckets).first()
        known, slot = Bucket.unpack(bytes(row["data"])).find(pa.array([hashlib.md5(name).digest()])) if row else ([False], None)
        if not known[0]:
            return None
        shard, first, n = slot[0].tolist()
        file = self.shards.where(F.col("shard") == shard).first()["file"]
        files, root = pa.fs.FileSystem.from_uri(self.folder)
        with files.open_input_file(f"{root}/{file}") as f:
            return np.frombuffer(f.read_at(self.width * n, self.width * first), f"<u{self.width}").tolist()

    def discard(self) -> None:
        """Deletes the files and tables."""
        discard(self.places, self.shards, self.index)
        system, path = _path(self.places.sparkSession, self.folder)
        system.delete(path, True)


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> TokenFiles:
    """Writes each whole text's ids and end_id in ascending order of ids, and the index over them.

    Null texts count as empty and are end_id alone. A null id comes after all others; rows that share an id stand side by
    side. Where ids repeat or lack, the index goes by names, id and row number, that the table of places lists;
    otherwise a document's name is its id as a string. Other columns are ignored. folder must be one that all machines
    share; by default it is made in spark.checkpoint.dir and goes when the session ends. path is read on each machine.
    A task holds one batch and one file's end; a document is the least that is written in one piece.
    """
    spark = docs.sparkSession
    made = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    system, at = _path(spark, made)
    system.mkdirs(at)
    if not folder:
        system.deleteOnExit(at)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    text_id = F.col("doc_id").cast("string")
    if kind == "string" and src.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).isEmpty():
        src, order = src.withColumn("name", text_id), [F.col("doc_id")]
    else:
        src, key, plain = row_keys(src, "doc_id")
        src = src.withColumn("name", text_id if plain else F.concat(F.coalesce(text_id, F.lit("")), F.lit("\0"), F.col(key).cast("string")))
        order = [F.col("doc_id")] if plain else [F.asc_nulls_last("doc_id"), F.col(key)]
    end, most, width = array("I", [end_id]).tobytes(), SHARD, 2 if max(byte_coder(path).largest, end_id) < 1 << 16 else 4
    ordered = src.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "name", "text")
    places = stash(ordered.mapInArrow(lambda it: _write(it, made, path, end, most, width), f"doc_id {kind}, name string, shard long, file string, first long, n long"), "places")
    sums = places.groupBy("shard", "file").agg(F.sum("n").alias("ids"), F.count(F.lit(1)).alias("rows"))
    shards = stash(sums.withColumn("base", F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")), "shards")
    _sweep(spark, made, shards)
    buckets = -(-(shards.agg(F.sum("rows")).first()[0] or 0) // KEYS) or 1
    keyed = places.select(_bucket(F.col("name"), buckets).alias("bucket"), _digest(F.col("name")).alias("digest"), "shard", "first", "n")
    index = stash(keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_build, "bucket long, data binary"), "index")
    return TokenFiles(made, places, shards, index, buckets, width)


def _sweep(spark, folder: str, shards: DataFrame) -> None:
    """Deletes files of ids that no committed row names: what failed or doubled tasks left."""
    system, at = _path(spark, folder)
    there = [f.getPath() for f in system.listStatus(at)]
    named = {r["file"] for r in shards.select("file").toLocalIterator()}
    for p in there:
        if p.getName().startswith("ids-") and p.getName() not in named:
            system.delete(p, False)
