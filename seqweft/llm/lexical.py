"""Ranked lexical search: three-phase uniform threshold (TPUT) over term-partitioned postings.

Each term has a list of postings (document, score), best first. Phase 1 fetches the heads of the lists of a query's
terms; the k-th best sum of what they show is a lower bound of the k-th best score. Phase 2 fetches from each list
what reaches the bound divided by the number of lists: a document below that in all lists cannot be among the best.
Sums of what came, and for each list that did not name the document the most it can still hold, give a better lower
bound and an upper bound for every document; those whose upper bound reaches the lower one, and the k-th best whole
score of documents that lead in the heads, are candidates. Phase 3 looks up the exact scores of the candidates.

Lists are kept in segments of some thousand documents each, so a term that a third of all documents hold is many rows.
Queries go in blocks: what a block's queries ask of a segment travels once, however many of them share the term, and
the sums of (block, segment) are made where its postings meet. Words come from whole texts; only words of queries
are kept, found by a filter of fixed size that travels to all tasks and then by the words themselves.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, keyed, stash, whole_groups
from .textscan import OTHERS, Words, coded, pieces

#: Bits of the filter of query terms (1 MB as bytes, whatever the number of queries).
BITS = 1 << 20
#: A segment ends with so many documents or postings of them; queries of a block on average; partitions that share one term.
DOCUMENTS, POSTINGS, BLOCK, SPREAD = 16_384, 1_500_000, 128, 16
#: The largest score of a posting is below this.
FULL = 1_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_TERMS = "key long, n long, terms array<string>, counts array<long>"


def _term_rows(batches, wanted: np.ndarray | None):
    """key, n (terms with repeats), and the different terms with their counts; with a filter, only terms that pass it."""
    for b in batches:
        for at, data, offs in pieces(b.column("text")):
            data = _FOLD[data]
            words = Words(data, offs, OTHERS)
            code, names = coded(data, words)
            row, size = words.row(), max(1, len(names))
            if wanted is not None:
                ok = wanted[np.fromiter((zlib.crc32(x) for x in names.to_pylist()), np.int64, len(names)) % len(wanted)][code]
                row, code = row[ok], code[ok]
            pair, count = np.unique(row * size + code, return_counts=True)
            ends = np.searchsorted(pair // size, np.arange(len(offs))).astype(np.int32)
            terms = names.take(pa.array(pair % size)).cast(pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("key").slice(at, len(offs) - 1), pa.array(np.diff(words.first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), terms), pa.ListArray.from_arrays(pa.array(ends), pa.array(count, pa.int64())),
                ],
                ["key", "n", "terms", "counts"],
            )


def _segments(batches, k: int, most: int, room: int):
    """(term, part, n, top, keys, scores, head): the postings of some thousand documents by term, best first, of at most `most` documents and about `room` postings; rows have key, m, terms, counts."""
    task, part, held, documents, postings = TaskContext.get().partitionId(), 0, [], 0, 0

    def out(held, part):
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("terms").chunk(0)
        per = np.diff(np.asarray(lists.offsets))
        term = lists.flatten().dictionary_encode()
        code = np.asarray(term.indices).astype(np.int64)
        key, m = (np.repeat(np.asarray(table.column(c).chunk(0)), per) for c in ("key", "m"))
        count = np.asarray(table.column("counts").chunk(0).flatten())
        score = 1_000_000_000 * count // (1000 * count + 8 * m)
        order = np.lexsort((key, FULL - score, code))
        code, key, score = code[order], key[order], score[order]
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        ends = np.append(begin, len(code)).astype(np.int32)
        head = np.minimum(np.diff(ends), k)
        first = np.repeat(begin - (np.cumsum(head) - head), head) + np.arange(head.sum())
        pairs = pa.StructArray.from_arrays([pa.array(key[first]), pa.array(score[first], pa.int32())], ["key", "score"])
        lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), x)
        return pa.RecordBatch.from_arrays(
            [
                term.dictionary.take(pa.array(code[begin])), pa.array(np.full(len(begin), task << 32 | part), pa.int64()), pa.array(np.diff(ends), pa.int64()),
                pa.array(score[begin], pa.int32()), lists(pa.array(key)), lists(pa.array(score, pa.int32())),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(head)).astype(np.int32)), pairs),
            ],
            ["term", "part", "n", "top", "keys", "scores", "head"],
        )

    for b in batches:
        per = np.diff(np.asarray(b.column("terms").offsets)) if b.num_rows else np.zeros(0, np.int64)
        at = 0
        while at < b.num_rows:
            fit = int(np.searchsorted(np.cumsum(per[at:]), room - postings, "right"))
            take = min(b.num_rows - at, most - documents, max(fit, 0 if held else 1))
            if take:
                held.append(b.slice(at, take))
                documents, postings, at = documents + take, postings + int(per[at : at + take].sum()), at + take
            if not take or documents >= most or postings >= room:
                yield out(held, part)
                held, documents, postings, part = [], 0, 0, part + 1
    if postings:
        yield out(held, part)


def _fetch(batches):
    """Of each segment what reaches the least score that a query of the block asks for."""
    for b in batches:
        if not b.num_rows:
            continue
        keys, scores, least = b.column("keys"), b.column("scores"), b.column("least").to_pylist()
        offs = np.asarray(keys.offsets).astype(np.int64)
        flat, points = np.asarray(keys.values), np.asarray(scores.values)
        shift = int(np.asarray(scores.offsets)[0] - offs[0])
        size = [int(np.searchsorted(-points[s + shift : e + shift], -x, "right")) for s, e, x in zip(offs[:-1].tolist(), offs[1:].tolist(), least, strict=True)]
        ends = np.append(0, np.cumsum(size)).astype(np.int64)
        pick = np.repeat(offs[:-1] - ends[:-1], size) + np.arange(ends[-1])
        cols = [b.column("cell"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[pick])), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(points[pick + shift], pa.int32())), b.column("asks")]
        yield pa.RecordBatch.from_arrays(cols, ["cell", "keys", "scores", "asks"])


def _sums(batches, k: int):
    """(q, key, least, most) of documents that may be among the k best of a query: bounds of their scores after phase 2."""
    for table in whole_groups(batches, "cell"):
        table = table.combine_chunks()
        cell = np.asarray(table.column("cell").chunk(0))
        cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = table.slice(lo, hi - lo)
            keys, scores = rows.column("keys").chunk(0), rows.column("scores").chunk(0)
            offs = np.asarray(keys.offsets).astype(np.int64)
            offs -= offs[0]
            document, at = np.unique(np.asarray(keys.flatten()), return_inverse=True)
            points = np.asarray(scores.flatten()).astype(np.int64)
            mine: dict[int, list] = {}
            for r, asks in enumerate(rows.column("asks").to_pylist()):
                for x in asks:
                    mine.setdefault(x["q"], []).append((r, x))
            for q, lists in mine.items():
                total, unseen = np.zeros(len(document), np.int64), np.full(len(document), lists[0][1]["all_rest"])
                for r, x in lists:
                    s, e = offs[r], offs[r + 1]
                    e = s + int(np.searchsorted(-points[s:e], -x["least"], "right"))
                    total[at[s:e]] += x["weight"] * points[s:e]
                    unseen[at[s:e]] -= x["rest"]
                bound = max(1, lists[0][1]["floor"])
                if len(total) >= k:
                    bound = max(bound, int(np.partition(total, len(total) - k)[len(total) - k]))
                hit = np.flatnonzero((total > 0) & (total + unseen >= bound))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hit), q), pa.int64()), pa.array(document[hit]), pa.array(total[hit]), pa.array((total + unseen)[hit])],
                    ["q", "key", "least", "most"],
                )


def _kth(sums: DataFrame, value: str, k: int) -> DataFrame:
    """(q, bound): of each query the k-th largest value, or 0 where there are fewer."""
    best = sums.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(value)))).where(F.col("k") <= k)
    return best.groupBy("q").agg(F.when(F.count(F.lit(1)) == k, F.min(value)).otherwise(0).alias("bound"))


def _length_part(n_documents: int, n_terms: int) -> Column:
    """m of a document: 100 - 90 + (90 n N) div L, in decimals as the product may pass 64 bits."""
    return F.expr(f"10 + (cast(90 as decimal(3,0)) * cast(n as decimal(16,0)) * cast({n_documents} as decimal(16,0))) div cast({max(1, n_terms)} as decimal(18,0))").cast("long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0 (all, if fewer), by descending score, then ascending id.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. With N documents that
    have terms, L terms in them, n in one, df documents with a term and tf times in one: the term weighs
    floor(1000 ln((2N+2)/(2df+1))), a document's m is 10 + (90 n N) div L, and its score sums
    weight * ((10^9 tf) div (1000 tf + 8 m)) over the item's different terms.

    Null and empty texts have no terms: such documents are never found, such items find nothing. Ids of any type; a
    null document id comes after all others. Rows that share an id, or have none, are documents (or items) of their own,
    ties among them by the order in which they were read; equal items give equal rows. Other columns are ignored.
    """
    src, plain = keyed(docs, id_col, text_col)
    ask, ask_plain = keyed(items, item_col, text_col)
    spark = docs.sparkSession
    asked = stash(ask.select("key", "text").mapInArrow(lambda it: _term_rows(it, None), _TERMS).select(F.col("key").alias("q"), F.explode("terms").alias("term")), "asked")
    places = asked.select((F.crc32(F.col("term").cast("binary")) % BITS).cast("int").alias("b")).distinct().toArrow()
    wanted = np.zeros(BITS, bool)
    wanted[np.asarray(places.column("b").combine_chunks())] = True
    counted = stash(src.select("key", "text").mapInArrow(lambda it: _term_rows(it, wanted), _TERMS), "term-rows")
    n_documents, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = counted.withColumn("m", _length_part(n_documents, n_terms))

    schema = "term string, part long, n long, top int, keys array<long>, scores array<int>, head array<struct<key:long,score:int>>"
    most, room = DOCUMENTS, POSTINGS
    lists = rows.where(F.size("terms") > 0).select("key", "m", "terms", "counts").mapInArrow(lambda it: _segments(it, k, most, room), schema)
    lists = stash(lists.repartition(F.col("term"), F.pmod(F.xxhash64("part"), F.lit(SPREAD))).sortWithinPartitions("term", F.desc("top")), "postings")
    known = lists.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    terms = stash(asked.join(known, "term").select("q", "term", weight.alias("weight"), "top").where("weight > 0 and top > 0"), "terms")

    # phase 1: heads of the lists
    heads = lists.select("term", F.explode("head").alias("h")).select("term", "h.key", "h.score")
    heads = heads.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "key"))).where(F.col("k") <= k)
    sums = heads.join(terms, "term").groupBy("q", "key").agg(F.sum(F.col("weight") * F.col("score")).alias("sum"))
    sums = stash(sums, "heads")
    bounds = _kth(sums, "sum", k)

    def exact(pairs: DataFrame) -> DataFrame:
        """(q, key, score) of the pairs (q, key), from the documents' own rows."""
        found = pairs.join(rows.select("key", "m", "terms", "counts"), "key")
        found = found.select("q", "key", "m", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("q", "key", "m", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf"))
        score = F.sum(F.expr("weight * ((1000000000 * tf) div (1000 * tf + 8 * m))")).alias("score")
        return found.join(terms.select("q", "term", "weight"), ["q", "term"]).groupBy("q", "key").agg(score).where("score > 0")

    # whole scores of the documents that lead in the heads: a closer bound for who is a candidate
    leading = sums.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sum"), "key"))).where(F.col("k") <= 4 * k)
    floors = _kth(exact(leading.select("q", "key")), "score", k).withColumnRenamed("bound", "floor")

    # phase 2: what reaches the bound divided by the number of lists
    number = terms.groupBy("q").agg(F.count(F.lit(1)).alias("m"))
    least = F.greatest(F.lit(1), F.expr("(bound + m * weight - 1) div (m * weight)")).cast("long")
    plan = terms.join(number, "q").join(bounds, "q", "left").join(floors, "q", "left")
    plan = plan.withColumn("bound", F.coalesce("bound", F.lit(0))).withColumn("floor", F.greatest("bound", F.coalesce("floor", F.lit(0))))
    plan = plan.withColumn("least", least).withColumn("rest", F.col("weight") * F.least("top", F.col("least") - 1))
    n_blocks = -(-ask.count() // BLOCK) or 1
    plan = stash(plan.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("long")), "plan")
    rests = plan.groupBy("q").agg(F.sum("rest").alias("all_rest"))
    asks = plan.where("least <= top").join(rests, "q").groupBy("block", "term")
    asks = asks.agg(F.min("least").alias("least"), F.collect_list(F.struct("q", "weight", "least", "rest", "all_rest", "floor")).alias("asks"))
    reached = lists.select("term", "part", "top", "keys", "scores").join(asks, "term").where("top >= least")
    reached = reached.select(F.xxhash64("block", "part").alias("cell"), "keys", "scores", "least", "asks")
    ask_type = "array<struct<q:long,weight:long,least:long,rest:long,all_rest:long,floor:long>>"
    reached = reached.mapInArrow(_fetch, f"cell long, keys array<long>, scores array<int>, asks {ask_type}")
    near = reached.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda it: _sums(it, k), "q long, key long, least long, most long")
    near = stash(near, "bounds")
    candidates = near.join(_kth(near, "least", k), "q").where("most >= bound").select("q", "key")

    # phase 3: exact scores of the candidates
    found = exact(candidates)
    found = found.withColumn("doc_id", F.col("key")) if plain else found.join(src.select("key", "doc_id"), "key")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "key")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = best.withColumn("item_id", F.col("q")) if ask_plain else best.join(ask.select(F.col("key").alias("q"), F.col("doc_id").alias("item_id")), "q")
    out = stash(best.select("item_id", "rank", "doc_id", "score"), "ranked")
    discard(asked, counted, lists, terms, sums, plan, near)
    return out
