"""Substring dedup by super-k-mers of words.

A window is K consecutive words. Its minimiser is the M-word run with the smallest hash in it, leftmost on ties, so
equal windows have equal minimisers. Consecutive windows that share a minimiser travel to the minimiser's bucket as one
string, where their windows are sorted and equal ones found by their bytes.

Texts of the same words (by sha256) lose all of them if they have K, so one of them travels for all. A minimiser that
occurs once in all these texts has no repeated windows, so occurrences are counted first, on hashes alone,
and only texts and super-k-mers with repeated minimisers travel. A bucket has at most MOST places; minimisers with more
(common lines, large groups of copies) go another exact way: their super-k-mers are put together by bytes before the
shuffle, and the windows of the different ones are counted by key, over as many tasks as there are.
"""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, stash, string_array, whole_groups
from .textscan import Words, pieces, runs

#: Words of a window (a fixed value of the query's contract) and of a minimiser.
K, M = 35, 8
#: Places of a minimiser that one bucket takes at most: some 50 MB of arrays in its task.
MOST = 8_000
#: Different strings that a task on the hot way puts together before it gives them out.
HELD = 50_000


def minimisers(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each window start (over all words of a piece) the hash of its minimiser and the minimiser's place; windows over row ends mean nothing."""
    g = runs(w.hashes()[0], M)
    span = K - M + 1
    n = len(g) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    v, at, width = g, np.arange(len(g)), 1

    def join(shift, upto):
        left = v[:upto] <= v[shift : shift + upto]
        return np.where(left, v[:upto], v[shift : shift + upto]), np.where(left, at[:upto], at[shift : shift + upto])

    while width * 2 <= span:
        v, at = join(width, len(v) - width)
        width *= 2
    if width < span:
        v, at = join(span - width, n)
    return v[:n], at[:n]


def super_kmers(data: np.ndarray, offs: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, row, first window's word, windows, minimiser hash) of each run of windows with one minimiser place."""
    w = Words(data, offs)
    v, at = minimisers(w)
    row = w.row()
    none = np.zeros(0, np.int64)
    if not len(v):
        return w, none, none, none, np.zeros(0, np.uint64)
    inside = row[: len(v)] == row[K - 1 : K - 1 + len(v)]
    change = np.ones(len(v), bool)
    change[1:] = (at[1:] != at[:-1]) | (row[1 : len(v)] != row[: len(v) - 1]) | (inside[1:] != inside[:-1])
    begin = np.flatnonzero(change)
    count = np.diff(np.concatenate([begin, [len(v)]]))
    ok = inside[begin]
    begin, count = begin[ok], count[ok]
    return w, row[begin], begin, count, v[begin]


def _profile(batches):
    """key, n_words, sha256 of the words joined by one space, and the minimiser of each super-k-mer."""
    for b in batches:
        for at, data, offs in pieces(b.column("text")):
            w, row, _, _, h = super_kmers(data, offs)
            n = len(offs) - 1
            raw = data.tobytes()
            joined = [hashlib.sha256(b" ".join(raw[s:e].split())).hexdigest() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("key").slice(at, n), pa.array(np.diff(w.first), pa.int64()), pa.array(joined), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))],
                ["key", "n_words", "sha", "marks"],
            )


def _travelling(batches, wanted: str):
    """(mark, key, first, packed) of each super-k-mer whose minimiser is in the row's list `wanted`."""
    for b in batches:
        lists = b.column(wanted)
        for at, data, offs in pieces(b.column("text")):
            w, row, begin, count, h = super_kmers(data, offs)
            part = lists.slice(at, len(offs) - 1)
            marks = np.asarray(part.flatten())
            owner = np.repeat(np.arange(len(part)), np.diff(np.asarray(part.offsets))) if len(part) else np.zeros(0, np.int64)
            listed = np.zeros(len(row), bool)
            here = h.view(np.int64)
            cuts, ends = np.searchsorted(row, np.arange(len(part) + 1)), np.searchsorted(owner, np.arange(len(part) + 1))
            for r in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(ends) > 0)).tolist():
                listed[cuts[r] : cuts[r + 1]] = np.isin(here[cuts[r] : cuts[r + 1]], marks[ends[r] : ends[r + 1]])
            pick = np.flatnonzero(listed)
            raw = data.tobytes()
            a, z = w.start[begin[pick]], w.end[begin[pick] + count[pick] + K - 2]
            packed = [b" ".join(raw[s:e].split()) for s, e in zip(a.tolist(), z.tolist(), strict=True)]
            keys = b.column("key").slice(at, len(part)).take(pa.array(row[pick]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(here[pick]), keys, pa.array(begin[pick] - w.first[row[pick]], pa.int64()), pa.array(packed, pa.binary()).cast(pa.string())],
                ["mark", "key", "first", "packed"],
            )


def _different(batches):
    """(packed, n): the different super-k-mers with hot minimisers, put together by bytes in each task as far as memory's bound allows."""
    seen: collections.Counter = collections.Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["packed", "n"])

    for b in batches:
        for part in _travelling([b], "hot"):
            seen.update(part.column("packed").to_pylist())
            if len(seen) > HELD:
                yield out()
                seen.clear()
    yield out()


def _named(batches, top: dict[bytes, int]):
    """key, hits (first, mask) of super-k-mers in `top`, and others (first, name): one row for each row."""
    for b in batches:
        for part in _travelling([b], "hot"):
            keys = np.asarray(part.column("key"))
            first = part.column("first").to_pylist()
            names = [hashlib.md5(p.encode()).digest() for p in part.column("packed").to_pylist()]
            cut = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
            hits, others = [], []
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                hits.append([{"first": first[i], "mask": top[names[i]]} for i in range(s, e) if top.get(names[i])])
                others.append([{"first": first[i], "name": names[i]} for i in range(s, e) if names[i] not in top])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[cut[:-1]]), pa.array(hits, pa.list_(pa.struct([("first", pa.int64()), ("mask", pa.int64())]))), pa.array(others, pa.list_(pa.struct([("first", pa.int64()), ("name", pa.binary())])))],
                ["key", "hits", "others"],
            )


def _windows(packed: list[bytes]):
    """(string's place, window's place in it, start, end) over the strings joined, and the joined bytes."""
    data = np.frombuffer(b"".join(packed), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(p) for p in packed])])
    w = Words(data, offs)
    row = w.row()
    n = max(0, len(row) - K + 1)
    ok = np.flatnonzero(row[:n] == row[K - 1 : K - 1 + n])
    return data, w, ok, row[ok], ok - w.first[row[ok]]


def _buckets(batches):
    """(key, first, mask): bit i of a super-k-mer's mask says that its window i also starts elsewhere."""
    for table in whole_groups(batches, "mark", 4_000):
        packed = [p.encode() for p in table.column("packed").to_pylist()]
        data, w, at, row, i = _windows(packed)
        mark = np.asarray(table.column("mark").combine_chunks())
        h = runs(w.hashes()[0], K)[at]
        order = np.lexsort((h, mark[row]))
        m, x = mark[row][order], h[order]
        same = (m[1:] == m[:-1]) & (x[1:] == x[:-1])
        raw = data.tobytes()
        start, end = w.start[at], w.end[at + K - 1]
        twice = np.zeros(len(at), bool)
        pair = np.flatnonzero(same)
        size = end - start
        for a, b in zip(order[pair].tolist(), order[pair + 1].tolist(), strict=True):
            if size[a] == size[b] and raw[start[a] : end[a]] == raw[start[b] : end[b]]:
                twice[a] = twice[b] = True
            else:  # hashes clash: each is held against all with its hash
                for j in np.flatnonzero(h == h[a]).tolist():
                    for k in np.flatnonzero(h == h[a]).tolist():
                        if j != k and mark[row[j]] == mark[row[k]] and raw[start[j] : end[j]] == raw[start[k] : end[k]]:
                            twice[j] = True
        mask = np.zeros(len(packed), np.int64)
        np.bitwise_or.at(mask, row[twice], np.int64(1) << i[twice])
        hit = np.flatnonzero(mask)
        yield pa.RecordBatch.from_arrays(
            [table.column("key").combine_chunks().take(pa.array(hit)), table.column("first").combine_chunks().take(pa.array(hit)), pa.array(mask[hit])],
            ["key", "first", "mask"],
        )


def _exploded(batches):
    """(window, name, i, n): digests of the windows of different super-k-mers; name is the super-k-mer's digest."""
    for b in batches:
        for lo in range(0, b.num_rows, 2_000):
            part = b.slice(lo, 2_000)
            packed = [p.encode() for p in part.column("packed").to_pylist()]
            data, w, at, row, i = _windows(packed)
            raw = data.tobytes()
            digests = [xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(w.start[at].tolist(), w.end[at + K - 1].tolist(), strict=True)]
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), part.column("name").take(rows), pa.array(i, pa.int32()), part.column("n").take(rows)], ["window", "name", "i", "n"])


def _cut(batches):
    """key, n_removed, kept_sha256, kept of rows with a list `hits` of (first, mask)."""
    for b in batches:
        texts = string_array(b.column("text")).to_pylist()
        removed, digest, kept = [], [], []
        for text, hits in zip(texts, b.column("hits").to_pylist(), strict=True):
            words = text.encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for h in hits:
                mask, at = h["mask"], h["first"]
                while mask:
                    low = mask & -mask
                    s = at + low.bit_length() - 1
                    gone[s] += 1
                    gone[s + K] -= 1
                    mask ^= low
            stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
            out = b" ".join([words[s] for s in stay])
            removed.append(len(words) - len(stay))
            digest.append(hashlib.sha256(out).hexdigest())
            kept.append(out)
        cols = [b.column("key"), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["key", "n_removed", "kept_sha256", "kept_text"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text (null where nothing goes).

    Removes each word that a window covers whose words also start anywhere else, in this or another row; all windows
    are judged on the input. Null and empty texts, and texts of fewer than K words, lose nothing. Rows with null or
    repeated ids are rows of their own, so repeated rows of K words or more lose all their words. Different
    super-k-mers on the way for hot minimisers are told apart by 128-bit digests, windows in buckets by their bytes.
    """
    src, plain = keyed(docs, id_col, text_col)
    profile = stash(src.select("key", "text").mapInArrow(_profile, "key long, n_words long, sha string, marks array<long>"), "profile")
    classes = stash(profile.groupBy("sha").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    places = profile.join(classes.select(F.col("rep").alias("key")), "key").select("key", F.explode("marks").alias("mark"))
    often = stash(places.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", (F.col("n") > MOST).alias("hot")), "often")
    wanted = places.distinct().join(often, "mark").groupBy("key").agg(F.collect_list(F.when(~F.col("hot"), F.col("mark"))).alias("cold"), F.collect_list(F.when(F.col("hot"), F.col("mark"))).alias("hot"))
    texts = stash(src.select("key", "text").join(wanted, "key"), "marked")
    travelling = "mark long, key long, first long, packed string"
    cold = texts.where(F.size("cold") > 0).select("key", "text", "cold").mapInArrow(lambda it: _travelling(it, "cold"), travelling)
    hits = cold.repartition("mark").sortWithinPartitions("mark").mapInArrow(_buckets, "key long, first long, mask long")
    part = F.array(F.struct("first", "mask"))
    parts = hits.select("key", part.alias("part"))
    if not often.where("hot").isEmpty():
        hot_texts = texts.where(F.size("hot") > 0).select("key", "text", "hot")
        different = hot_texts.mapInArrow(_different, "packed string, n long")
        different = stash(different.groupBy("packed").agg(F.sum("n").alias("n")).withColumn("name", F.unhex(F.md5("packed"))), "different")
        windows = stash(different.select("packed", "n", "name").mapInArrow(_exploded, "window binary, name binary, i int, n long"), "windows")
        twice = windows.groupBy("window").agg(F.sum("n").alias("all")).where("all > 1").select("window")
        masks = windows.join(twice, "window").groupBy("name").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
        masks = stash(masks, "masks")
        # super-k-mers with a thousandth of all places, of which there are at most a thousand, are looked up where they are made
        total = different.agg(F.sum("n")).first()[0] or 0
        common = different.where(F.col("n") * 1000 >= total).select("name")
        top = {bytes(r["name"]): r["mask"] or 0 for r in common.join(masks, "name", "left").collect()}
        rows = stash(hot_texts.mapInArrow(lambda it: _named(it, top), "key long, hits array<struct<first:long,mask:long>>, others array<struct<first:long,name:binary>>"), "named")
        rare = rows.select("key", F.explode("others").alias("x")).select("key", "x.first", "x.name").join(masks, "name")
        parts = parts.union(rare.select("key", part.alias("part"))).union(rows.where(F.size("hits") > 0).select("key", F.col("hits").alias("part")))
    gathered = parts.groupBy("key").agg(F.flatten(F.collect_list("part")).alias("hits"))
    cut = texts.select("key", "text").join(gathered, "key").mapInArrow(_cut, "key long, n_removed long, kept_sha256 string, kept_text string")
    if not with_text:
        cut = cut.drop("kept_text")
    rows = profile.select("key", "n_words", "sha").join(cut, "key", "left").join(classes.select("sha", "copies"), "sha")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= K)  # each window starts in a copy too
    rows = rows.withColumn("n_removed", F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")))
    rows = rows.withColumn("kept_sha256", F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")))
    if with_text:
        rows = rows.withColumn("kept_text", F.when(whole, F.lit("")).otherwise(F.col("kept_text")))
    rows = rows.withColumn("doc_id", F.col("key")) if plain else rows.join(src.select("key", "doc_id"), "key")
    return rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *(["kept_text"] if with_text else []))
