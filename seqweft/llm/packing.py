"""Best-fit packing of token sequences by linear grouping.

Lengths are integers up to the capacity, so their histogram has at most that many rows whatever the input. The plan is
made on it: large lengths are put in groups of equal cardinality and rounded up to the group's largest; a linear
programme over configurations of these few sizes (columns made by a knapsack) says how many sequences follow each
configuration; each of its places takes the longest document left that it holds, the last one also the room that
rounding left; then the few that are left and the small ones go, largest first, where they leave the least room. The
plan speaks of runs: so many sequences with the same lengths.
A document finds its place by its rank among those of its length, so nothing but narrow rows moves.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import stash, string_array

#: Lengths above this share of the capacity are large.
LARGE = 1 / 4
#: Groups of large lengths, and columns that the linear programme adds at most (far more than it took on any histogram tried).
GROUPS, COLUMNS = 64, 2_000


class WordBpe:
    """A tokenizer file whose splitting never crosses white space and marks the ends of words, run by tiktoken's merge loop.

    Ends are marked by a space behind each piece, which no piece holds: the single symbols that end a word come before
    all merges, so the loop makes them first and then merges as the file's list says. Pieces of Latin letters are split
    here; words with letters beyond them go to the file's own library, as versions of Unicode differ. Nothing is kept
    between texts, so memory is that of the vocabulary.
    """

    #: The file's pattern (a fixed value of the public tokenizer) for characters below U+0250, where the numbers are the digits and these six.
    PATTERN = r"[^\W\d_²³¹¼½¾]++|'(?:[stmd]|re|ve|ll)|[0-9²³¹¼½¾]|(?:[^\w\s]|_)++"
    END = "</w>"

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, self.special = byte_letters(), [t["content"] for t in spec["added_tokens"]]
        vocab = spec["model"]["vocab"]

        def marked(token: str) -> bytes:
            body = token.removesuffix(self.END)
            return bytes(letters[c] for c in body) + b" " * (body != token)

        made = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
        single = sorted((t for t in vocab if len(t.removesuffix(self.END)) == 1), key=lambda t: (t.endswith(self.END), t))
        if len(set(made)) < len(made):
            raise ValueError("two merges make one token; the loop takes a token's rank for that of its merge")
        tokens = single + made  # their places are the loop's ranks
        self.ids = np.array([vocab[t] for t in tokens], np.uint32)
        self.merge = Encoding("words", pat_str="[^ ]+ ", mergeable_ranks={marked(t): i for i, t in enumerate(tokens)}, special_tokens={}).encode_ordinary
        self.split = re.compile(self.PATTERN).findall
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.unlike = re.compile("[\x1c-\x1f\x85\u180e]").search  # white space to some libraries only
        self.far = re.compile("[^\x00-\u024f]").search
        self.far_words = re.compile(r"(?<!\S)([^\s\u0250-\U0010ffff]*+[^\x00-\u024f\s]\S*+)").split

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _latin(self, text: str) -> bytes:
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
        pieces = self.split(text)
        pieces.append("")
        return self.ids[self.merge(" ".join(pieces))].tobytes()

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if self.unlike(text) or any(s in text for s in self.special):
            return self._whole(text)
        if not self.far(text):
            return self._latin(text)
        return b"".join([self._whole(part) if i % 2 else self._latin(part) for i, part in enumerate(self.far_words(text))])


_coders: dict[str, WordBpe] = {}


def word_coder(path: str) -> WordBpe:
    """The process's own coder: a worker reads the vocabulary once for all its tasks."""
    if path not in _coders:
        _coders[path] = WordBpe(path)
    return _coders[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with_ids, ids: of each document its ids and end_id, cut at capacity."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def work(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        coder, end, step = word_coder(path), array("I", [end_id]).tobytes(), 4 * capacity
        for b in batches:
            texts = string_array(b.column("text")).to_pylist()
            for at in range(0, len(texts), 1000):
                who, piece, start, crc, size, ids = [], [], [], [], [], []
                for i, text in enumerate(texts[at : at + 1000]):
                    code = coder.encode(text) + end
                    for k, s in enumerate(range(0, len(code), step)):
                        x = code[s : s + step]
                        who.append(at + i)
                        piece.append(k)
                        start.append(s // 4)
                        size.append(len(x) // 4)
                        crc.append(zlib.crc32(x))
                        if with_ids:
                            ids.append(array("I", x).tolist())
                cols = [b.column("doc_id").take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return src.mapInArrow(work, schema)


class _Runs:
    """Sequences in runs of equal lengths. A run: [first, how many, room, [(length, first rank, offset), ...]]."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.rank: dict[int, int] = {}
        self.rooms: dict[int, list[list]] = {}
        self.mask = 0  # bit r: a run with room r stands open

    def take(self, length: int, n: int) -> int:
        """The first of the next n ranks of a length."""
        r = self.rank.get(length, 0)
        self.rank[length] = r + n
        return r

    def keep(self, run: list) -> None:
        self.rooms.setdefault(run[2], []).append(run)
        self.mask |= 1 << run[2]

    def open(self, n: int, lengths: list[int]) -> None:
        """n new sequences with these lengths each."""
        slots, at = [], 0
        for x in lengths:
            slots.append((x, self.take(x, n), at))
            at += x
        self.keep([self.sequences, n, self.capacity - at, slots])
        self.sequences += n

    def fit(self, length: int, n: int) -> None:
        """n documents of a length where they leave the least room; new sequences for the rest."""
        while n and (above := self.mask >> length):
            room = length + (above & -above).bit_length() - 1
            first, m, _, slots = run = self.rooms[room].pop()
            if not self.rooms[room]:
                self.mask &= ~(1 << room)
            t = min(m, n)
            if t < m:
                self.keep([first + t, m - t, room, [(x, r + t, at) for x, r, at in slots]])
            run[1:] = t, room - length, [*slots, (length, self.take(length, t), self.capacity - room)]
            self.keep(run)
            n -= t
        each = self.capacity // length
        if n >= each:
            self.open(n // each, [length] * each)
        if n % each:
            self.open(1, [length] * (n % each))

    def places(self) -> np.ndarray:
        """(length, first rank, first sequence, offset, how many) of every slot of every run."""
        rows = [(x, r, first, at, m) for runs in self.rooms.values() for first, m, _, slots in runs for x, r, at in slots]
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _best_column(sizes: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth: a knapsack over the capacity, unbounded, with choices traced back."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    least = int(sizes.min())
    for c in range(least, capacity + 1):
        gain = np.where(sizes <= c, value[np.maximum(c - sizes, 0)] + worth, -1.0)
        k = int(gain.argmax())
        if gain[k] > value[c - 1] + 1e-12:
            value[c], choice[c] = gain[k], k
        else:
            value[c] = value[c - 1]
    column, c = np.zeros(len(sizes), int), capacity
    while c >= least:
        if choice[c] < 0:
            c -= 1
            continue
        column[choice[c]] += 1
        c -= int(sizes[choice[c]])
    return float(column @ worth), column


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, how often each size) of a cutting-stock programme, rounded down: basic columns of its optimum."""
    s, need = np.array(sizes), np.array(counts, float)
    k = len(s)
    basis = np.diag(capacity // s).astype(float)  # columns: one size each
    x = need / np.diag(basis)
    for _ in range(COLUMNS):
        worth = np.linalg.solve(basis.T, np.ones(k))
        gain, column = _best_column(s, np.maximum(worth, 0), need, capacity)
        if gain <= 1 + 1e-7:
            break
        way = np.linalg.solve(basis, column.astype(float))
        able = way > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * way, 0)
        x[out] = step
        basis[:, out] = column
    return [(int(x[j] + 1e-9), basis[:, j].astype(int).tolist()) for j in np.argsort(-x) if x[j] >= 1]


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Places (length, first rank, first sequence, offset, how many) and the number of sequences. Without groups all lengths go by best fit."""
    runs = _Runs(capacity)
    left = {x: n for x, n in histogram.items() if n}
    if left.get(capacity):
        runs.open(left.pop(capacity), [capacity])
    large = sorted(x for x in left if x > capacity * LARGE) if groups else []
    if large:
        stock = [left.pop(x) for x in large]
        each = -(-sum(stock) // groups)
        sizes: dict[int, int] = {}  # the largest length of each group -> documents; equal ones together
        room = 0
        for x, n in zip(reversed(large), reversed(stock), strict=True):
            while n:
                if not room:
                    size, room = x, each
                t = min(n, room)
                sizes[size] = sizes.get(size, 0) + t
                n, room = n - t, room - t

        def longest(most: int, taken: list[int]) -> int:
            """The place of the longest length up to `most` of which more documents are left than `taken`, or -1."""
            i = bisect.bisect_right(large, most) - 1
            while i >= 0 and stock[i] <= taken.count(i):
                i -= 1
            return i

        for n, column in configurations(list(sizes), list(sizes.values()), capacity):
            places = [z for z, times in zip(sizes, column, strict=True) for _ in range(times)]
            while n:
                # as many sequences at once as documents of the same lengths are left for; the last place also takes what rounding left
                taken: list[int] = []
                for k, z in enumerate(places):
                    free = capacity - sum(large[i] for i in taken)
                    i = longest(min(z, free) if k < len(places) - 1 else free, taken)
                    if i >= 0:
                        taken.append(i)
                if not taken:
                    break
                t = min(n, *(stock[i] // taken.count(i) for i in taken))
                for i in taken:
                    stock[i] -= t
                runs.open(t, [large[i] for i in taken])
                n -= t
                while large and not stock[-1]:
                    large.pop(), stock.pop()
        left.update((x, n) for x, n in zip(large, stock, strict=True) if n)
    for x in sorted(left, reverse=True):
        runs.fit(x, left[x])
    return runs.places(), runs.sequences


def least_plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """The plan with groups, or with none where rounding up costs more than configurations save: the one of fewer sequences."""
    return min((plan(histogram, capacity, groups) for groups in (GROUPS, 0)), key=lambda p: p[1])


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (any columns, with longs length, from 1 to capacity, and key_, unique) with sequence_id and offset.

    pieces is read three times: pass a written table. Ranks among equal lengths are taken in hash buckets of about
    50,000 rows with running totals, so a length that a third of all pieces have is ranked by many tasks.
    The plan sent to workers has a row for each slot of each run: a few times capacity, whatever the input.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places, _ = least_plan(histogram, capacity)
    buckets = max(64, sum(histogram.values()) // 50_000)
    rows = pieces.withColumn("bucket_", F.pmod(F.xxhash64("key_"), F.lit(buckets)))
    total = rows.groupBy("length", "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("length").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = total.select("length", "bucket_", before.alias("before_"))
    ranked = rows.withColumn("rank_", F.row_number().over(Window.partitionBy("length", "bucket_").orderBy("key_")) - 1)
    ranked = ranked.join(offsets, ["length", "bucket_"]).withColumn("rank_", F.col("rank_") + F.col("before_")).drop("bucket_", "before_", "key_")
    wide = 1 << 44
    starts = spark.sparkContext.broadcast((places[:, 0] * wide + places[:, 1], places))
    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.drop("rank_").dtypes) + ", sequence_id long, offset long"

    def place(batches):
        first, table = starts.value
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank_"))
            at = np.searchsorted(first, length * wide + rank, "right") - 1
            hit = table[at]
            keep = [i for i, n in enumerate(b.schema.names) if n != "rank_"]
            cols = [b.column(i) for i in keep] + [pa.array(hit[:, 2] + rank - hit[:, 1]), pa.array(hit[:, 3])]
            yield pa.RecordBatch.from_arrays(cols, [*(b.schema.names[i] for i in keep), "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every document.

    Null texts count as empty: one piece with the end id. Longer documents than capacity are cut, shorter ones never.
    Repeated rows and null ids are documents of their own; other columns are ignored; an empty table gives no rows.
    Tokens are made once, into a table of the shared folder; the rest works on its narrow rows.
    """
    pieces = stash(token_pieces(docs, path, capacity, 0, id_col, text_col, with_ids).withColumn("key_", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
