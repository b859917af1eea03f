"""MinHash near-dedup by fast similarity sketching.

A sketch has T coordinates. In each of T rounds every shingle is thrown into a hashed bin, which keeps the smallest hash
of the first round that reaches it; T more rounds fill bin after bin, so every coordinate is filled even for one
shingle, and the share of equal coordinates of two sketches is concentrated around the sets' similarity. Bands of
coordinates are matched; what they bring together is confirmed on full sets, and links on the shingles' bytes.

Texts of the same words are one class with one representative. Matched bands make a graph of stars, a row for each band
and class, whose components ("blobs") hold every candidate pair. A blob that fits one task is verified there, each set
sent once. Of a larger blob all members are first held against one of them, its chief, over many tasks: one pass, linear
in the blob. Those that are linked to it are one component; by the triangle inequality of the Jaccard distance the
others can only be linked to those of them whose distance to the chief is near enough to their own, so the rest of the
component is done with. What is left is matched by its rare shingles: ordered by how many of these sets hold them, two
linked sets share one of their first ones, and the place of the first shared one bounds what they can have in common.
A set stays in a shingle's group only if for the sizes that stand there the bound allows a link to one of them, so
pages that share a template and differ by more than the threshold leave their groups all at once. Groups are verified,
large ones in blocks, where only pairs of different components are held against each other. A task gives out no pairs
but a forest that has the components of its links, so results stay linear in the input. All steps are linear in the
sets and their shingles but the blocks: sets that the bound leaves in one group, more than a task takes, of many
components that are not linked to the chief.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed, row_keys, stash, whole_groups
from .graph import connected_components
from .textscan import Words, mix, pieces, runs

#: Words of a shingle; coordinates of a sketch; bands of T / BANDS coordinates. Two sets of similarity 0.85 miss each
#: other in all bands with probability (1 - 0.85^6)^32 = 2.7e-7.
SHINGLE, T, BANDS = 5, 192, 32
#: Links: 100 * intersection >= SIMILAR * union.
SIMILAR = 85
#: Sets, and shingles in all of them, that one task verifies at a time; and members of a larger blob that one chunk holds against its chief.
MOST_SETS, MOST_SHINGLES, CHUNK = 1_000, 1_000_000, 200
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Of each row the sorted distinct 64-bit hashes of its shingles; with fewer words, of the whole sequence."""
    w = Words(data, offs)
    h = w.hashes(lower=True)[0]
    g = runs(h, SHINGLE)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            s = np.sort(g[a : b - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(runs(h[a:b], b - a) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of T coordinates; rows of empty sets mean nothing."""
    n = len(sets)
    out = np.full(n * T, _FULL)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    value = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    for i in range(2 * T):
        if not len(value):
            break
        x = mix(value + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = ((x >> np.uint64(32)) * np.uint64(T) >> np.uint64(32)).astype(np.int64) if i < T else i - T
        now = np.full(n * T, _FULL)
        np.minimum.at(now, row * T + place, np.uint64(i) << np.uint64(32) | x & np.uint64(0xFFFFFFFF))
        out = np.minimum(out, now)  # a bin that is filled keeps its earlier round, as that is the higher part
        if i < 3 or i % 8 == 0:
            open_rows = (out.reshape(n, T) == _FULL).any(1)
            keep = open_rows[row]
            row, value = row[keep], value[keep]
    return out.reshape(n, T)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    n, each = len(sketch), T // BANDS
    parts = sketch.reshape(n, BANDS, each)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), (n, BANDS)).copy()
    for j in range(each):
        key = mix(key + parts[:, :, j])
    return key.view(np.int64)


def lowered_words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def shingles_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """The shingles themselves, not their hashes."""
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else {tuple(words)}


def _sketch_batches(batches):
    for b in batches:
        for at, data, offs in pieces(b.column("text")):
            sets = shingle_sets(data, offs)
            size = np.array([len(s) for s in sets])
            keys = band_keys(sketches(sets))
            ends = np.concatenate([[0], np.cumsum((size > 0) * BANDS)]).astype(np.int32)
            n, raw = len(sets), data.tobytes().lower()
            same = [hashlib.sha256(b" ".join(raw[s:e].split())).digest() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("key").slice(at, n), b.column("doc_id").slice(at, n), pa.array(size, pa.int64()), pa.array(same, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[size > 0].ravel()))],
                ["key", "doc_id", "n_shingles", "digest", "bands"],
            )


def forest(sets: list[np.ndarray], similar: int = SIMILAR, labels: list | None = None, confirm=None) -> list[tuple[int, int]]:
    """Links that have the components of all links among the sets. Candidates share one of their rarest shingles (prefix filter).

    Sets with one label are known to be of one component. confirm(i, j) has the last word on a link.
    """
    n = len(sets)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: dict = {}
    for i, x in enumerate(labels or ()):
        root[i] = find(first.setdefault(x, i))
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    flat = rank[code]
    begin = np.concatenate([[0], np.cumsum(size)])
    for i in range(n):
        flat[begin[i] : begin[i + 1]].sort()
    prefix = size - (similar * size + 99) // 100 + 1
    place = np.concatenate([np.arange(k) for k in prefix])
    inside = np.concatenate([flat[begin[i] : begin[i] + prefix[i]] for i in range(n)])
    owner = np.repeat(np.arange(n), prefix)
    order = np.argsort(inside, kind="stable")
    inside, owner, place = inside[order], owner[order], place[order]
    rest = size[owner] - place  # what two sets can share from their first common shingle on
    mark = np.zeros(len(times), bool)
    links = []
    for i in range(n):
        mine = flat[begin[i] : begin[i + 1]]
        head = mine[: prefix[i]]
        lo, hi = np.searchsorted(inside, head), np.searchsorted(inside, head, "right")
        many = hi > lo + 1
        if not many.any():
            continue
        shared = np.concatenate([np.arange(a, b) for a, b in zip(lo[many], hi[many], strict=True)])
        mine_left = np.repeat((size[i] - np.arange(len(head)))[many], (hi - lo)[many])
        other = owner[shared]
        able = (other < i) & ((100 + similar) * np.minimum(rest[shared], mine_left) >= similar * (size[other] + size[i]))
        near = np.unique(other[able])
        near = near[(100 * np.minimum(size[near], size[i]) >= similar * np.maximum(size[near], size[i]))]
        me = find(i)
        near = np.array([j for j in near.tolist() if find(j) != me], np.int64)
        if not len(near):
            continue
        mark[mine] = True
        at = np.concatenate([[0], np.cumsum(size[near])])
        places = np.arange(at[-1]) + np.repeat(begin[near] - at[:-1], size[near])
        common = np.add.reduceat(mark[flat[places]].astype(np.int64), at[:-1])
        mark[mine] = False
        for j in near[100 * common >= similar * (size[i] + size[near] - common)].tolist():
            a, b = find(i), find(j)
            if a != b and (confirm is None or confirm(i, j)):
                root[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def _confirmed(texts: list[str], similar: int):
    """Whether two texts' sets are linked, by the shingles' bytes; the last set is kept, as it is asked for again."""
    kept: dict[int, set] = {}

    def shingles(i: int) -> set:
        if i not in kept:
            if len(kept) > 1:
                kept.clear()
            kept[i] = shingles_of(lowered_words(texts[i]))
        return kept[i]

    def confirm(i: int, j: int) -> bool:
        a, b = shingles(i), shingles(j)
        common = len(a & b)
        return 100 * common >= similar * (len(a) + len(b) - common)

    return confirm


def _verify_batches(batches, similar: int):
    """Links (a, b) among the sets of each group gid."""
    for table in whole_groups(batches, "gid", 4_000):
        texts = table.column("text").to_pylist()
        sets = [s for _, data, offs in pieces(table.column("text")) for s in shingle_sets(data, offs)]
        gid, key, label = (np.asarray(table.column(c).combine_chunks()) for c in ("gid", "key", "label"))
        cut = np.concatenate([[0], np.flatnonzero(gid[1:] != gid[:-1]) + 1, [len(gid)]])
        a, b = [], []
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            for i, j in forest(sets[s:e], similar, label[s:e].tolist(), _confirmed(texts[s:e], similar)):
                a.append(key[s + i])
                b.append(key[s + j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _against_chief(batches, similar: int):
    """(key, linked, distance) of each row against the chief of its blob, the first row of its chunk."""
    chief = chief_text = None
    for batch in batches:
        for at, data, offs in pieces(batch.column("text")):
            part = batch.slice(at, len(offs) - 1)
            first, keys, texts = part.column("first").to_pylist(), part.column("key").to_pylist(), part.column("text").to_pylist()
            out: list[tuple] = []
            for i, s in enumerate(shingle_sets(data, offs)):
                if first[i]:
                    chief, chief_text = s, texts[i]
                    continue
                where = np.minimum(np.searchsorted(chief, s), len(chief) - 1)
                common = int((chief[where] == s).sum())
                union = len(chief) + len(s) - common
                linked = 100 * common >= similar * union and _confirmed([chief_text, texts[i]], similar)(0, 1)
                out.append((keys[i], linked, 1 - common / union))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.float64()))], ["key", "linked", "distance"])


def _stars(rows: DataFrame, *more) -> DataFrame:
    """rows (key, band, ...) with a bucket's hub, size n and shingles weight, where more than one row shares a band."""
    shared = rows.groupBy("band").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"), *more).where("n > 1")
    return rows.join(shared, "band")


def _links(texts: DataFrame, matches: DataFrame, similar: int) -> list[DataFrame]:
    """Written tables (a, b) of links that have the components of all of them. texts: key, text; matches: key, n_shingles, band, hub, n, weight."""
    blobs = connected_components(matches.select(F.col("key").alias("a"), F.col("hub").alias("b")))
    nodes = matches.groupBy("key").agg(F.first("n_shingles").alias("n_shingles"), F.sum("n").alias("degree"))
    nodes = stash(nodes.join(blobs, "key", "left").withColumn("blob", F.coalesce("comp", "key")).drop("comp"), "members")
    sizes = stash(nodes.groupBy("blob").agg(F.count(F.lit(1)).alias("sets"), F.sum("n_shingles").alias("in_all"), F.max_by("key", F.struct("degree", -F.col("key"))).alias("chief")), "sizes")
    fits = (F.col("sets") <= MOST_SETS) & (F.col("in_all") <= MOST_SHINGLES)
    todo = nodes.join(sizes.where(fits), "blob").select(F.col("blob").alias("gid"), "key", F.col("key").alias("label"))
    large = sizes.where(~fits)
    links, done = [], [blobs, nodes, sizes]
    if not large.isEmpty():
        # every member of a large blob against its chief, in chunks that each have the chief's text in front
        chunks = F.ceil(F.greatest(F.col("sets") / CHUNK, F.col("in_all") / MOST_SHINGLES)).cast("long")
        parted = large.select("blob", "chief", chunks.alias("chunks"))
        members = nodes.join(parted, "blob").where("key <> chief").select("blob", F.pmod(F.xxhash64("key"), "chunks").alias("chunk"), F.lit(False).alias("first"), "key")
        fronts = parted.select("blob", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("first"), F.col("chief").alias("key"))
        rows = members.union(fronts).join(texts, "key").repartition("blob", "chunk").sortWithinPartitions("blob", "chunk", F.desc("first"))
        held = rows.select("key", "first", "text").mapInArrow(lambda it: _against_chief(it, similar), "key long, linked boolean, distance double")
        held = stash(held.join(nodes.select("key", "blob"), "key").join(parted.select("blob", "chief"), "blob"), "held")
        links.append(stash(held.where("linked").select(F.col("key").alias("a"), F.col("chief").alias("b")), "chief-links"))
        # of the linked ones, only those that the others may still reach
        nearest = held.where(~F.col("linked")).groupBy("blob").agg(F.min("distance").alias("nearest"))
        kept = held.join(nearest, "blob").where(~F.col("linked") | (F.col("distance") >= F.col("nearest") - (1 - similar / 100) - 1e-9))
        kept = kept.select("blob", "key", F.when(F.col("linked"), F.col("chief")).otherwise(F.col("key")).alias("label"))
        rest = stash(_able(kept, texts, similar), "rest")
        todo = todo.unionByName(_blocks(rest))
        done += [held, rest]
    rows = todo.join(texts, "key").select("gid", "key", "label", "text")
    links.append(stash(rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(lambda it: _verify_batches(it, similar), "a long, b long"), "links"))
    discard(*done)
    return links


def _shingle_rows(batches):
    for b in batches:
        for at, data, offs in pieces(b.column("text")):
            sets = shingle_sets(data, offs)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            part = b.slice(at, len(sets))
            yield pa.RecordBatch.from_arrays([part.column("blob"), part.column("key"), part.column("label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["blob", "key", "label", "shingles"])


def _able(kept: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """(key, n_shingles, label, band, hub): sets (blob, key, label) in the groups of those rare shingles by which they can be linked.

    A blob's shingles are ordered by the number of its sets that have them. Two linked sets share one of their first
    size - similar % + 1, and from the first shared one on at least what a link takes of both sizes. band is the shingle,
    hub the blob.
    """
    sets = kept.join(texts, "key").select("blob", "key", "label", "text").mapInArrow(_shingle_rows, "blob long, key long, label long, shingles array<long>")
    sets = stash(sets, "shingles")
    each = sets.select("blob", "key", "label", F.size("shingles").alias("size"), F.explode("shingles").alias("band"))
    times = each.groupBy("blob", "band").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(times, ["blob", "band"]).groupBy("blob", "key", "label", "size").agg(F.sort_array(F.collect_list(F.struct("n", "band"))).alias("x"))
    first = F.col("size") - F.ceil(F.col("size") * similar / F.lit(100)).cast("int") + 1
    heads = ranked.select("blob", "key", "label", "size", F.posexplode(F.slice("x", F.lit(1), first)).alias("at", "x")).where("x.n > 1")
    heads = stash(heads.select("blob", "key", "label", "size", F.col("x.band").alias("band"), (F.col("size") - F.col("at")).alias("left")), "heads")
    sizes = heads.groupBy("blob", "band", "size").agg(F.max("left").alias("left"), F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most"))
    groups = sizes.groupBy("blob", "band").agg(F.collect_list(F.struct("size", "left", "n")).alias("there"), F.min("least").alias("least"), F.max("most").alias("most"))

    def fits(t):
        alike = (100 * F.least(t["size"], "size") >= similar * F.greatest(t["size"], "size")) & ((t["size"] != F.col("size")) | (t["n"] > 1))
        return alike & ((100 + similar) * F.least(t["left"], "left") >= similar * (t["size"] + F.col("size")))

    rows = heads.join(groups.where("least <> most").select("blob", "band", "there"), ["blob", "band"]).where(F.exists("there", fits))
    rows = rows.select("key", F.col("size").cast("long").alias("n_shingles"), "label", "band", F.col("blob").alias("hub"))
    out = stash(rows, "able")
    discard(sets, heads)
    # a shingle that one component alone has left links nothing
    mixed = out.groupBy("hub", "band").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("hub", "band")
    return out.join(mixed, ["hub", "band"]).select("key", "n_shingles", "label", "band", "hub")


def _blocks(rows: DataFrame) -> DataFrame:
    """(gid, key, label): of buckets (key, n_shingles, label, band, hub) those that fit a task, and of larger ones each block of
    the members that are not of the bucket's commonest label with each block of all: no pair within that label is looked at again."""
    tally = rows.groupBy("band", "hub", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    load = F.greatest(F.sum("n") / F.lit(MOST_SETS), F.sum("w") / F.lit(MOST_SHINGLES))
    tally = tally.groupBy("band", "hub").agg(load.alias("load"), F.max(F.struct("n", "w", "label")).alias("top"))
    main = F.greatest(F.col("top.n") / F.lit(MOST_SETS), F.col("top.w") / F.lit(MOST_SHINGLES))
    parts = lambda x: F.when(F.col("load") <= 1, 1).otherwise(F.ceil(2 * x)).cast("long")
    tally = tally.select("band", "hub", F.col("top.label").alias("common"), parts(F.col("load")).alias("wide"), F.greatest(parts(F.col("load") - main), F.lit(1)).alias("narrow"))
    rows = rows.join(tally, ["band", "hub"])
    spot = F.xxhash64("key", F.lit(1))
    as_any = F.transform(F.sequence(F.lit(0).cast("long"), F.col("narrow") - 1), lambda k: F.struct(F.pmod(spot, "wide").alias("i"), k.alias("j")))
    as_other = F.transform(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1), lambda k: F.struct(k.alias("i"), F.pmod(spot, "narrow").alias("j")))
    cells = F.when(F.col("label") == F.col("common"), as_any).otherwise(F.array_union(as_any, as_other))
    rows = rows.select("band", "hub", "key", "label", F.explode(cells).alias("cell"))
    return rows.select(F.xxhash64("band", "hub", "cell.i", "cell.j").alias("gid"), "key", "label").distinct()


def _grouped(src: DataFrame, similar: int) -> DataFrame:
    """key, doc_id, n_shingles, comp (smallest key of the component; null for an empty set). src: key, doc_id, text."""
    kind = dict(src.dtypes)["doc_id"]
    s = stash(src.mapInArrow(_sketch_batches, f"key long, doc_id {kind}, n_shingles long, digest binary, bands array<long>"), "sketches")
    classes = stash(s.where("n_shingles > 0").groupBy("digest").agg(F.min("key").alias("rep")), "classes")
    reps = s.join(classes.select(F.col("rep").alias("key")), "key").select("key", "n_shingles", F.explode("bands").alias("band"))
    matches = stash(_stars(reps), "matches")
    links = _links(src.select("key", "text"), matches, similar)
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    comps = connected_components(every)
    named = stash(classes.join(comps, classes.rep == comps.key, "left").select("digest", F.coalesce("comp", "rep").alias("comp")), "components")
    discard(classes, matches, comps, *links)
    return s.join(named, "digest", "left").select("key", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("comp")).alias("comp"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A document's set: the distinct shingles of SHINGLE words, A-Z lower-cased; with fewer words the whole sequence;
    null and empty texts have none and are linked with nothing. A text of any length is one set in its task. component_id is the smallest id reachable by links.
    Links are confirmed by the shingles' bytes; texts count as equal by the sha256 of their words. Ids may be of any
    type. Ids that are null or repeat get row numbers inside and keep their values outside: rows of one id are documents
    of their own, component_id is the smallest id among those reachable, null if all are null. Other columns are ignored.
    """
    src, plain = keyed(docs, id_col, text_col)
    out = _grouped(src, similar)
    if plain:
        kind = dict(src.dtypes)["doc_id"]
        out = out.select("doc_id", "n_shingles", F.coalesce("comp", "key").cast(kind).alias("component_id"))
    else:
        out = stash(out, "grouped")
        least = out.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        out = out.join(least, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """One row of each group of near copies, with all its columns: the one with the smallest id.

    Null and empty texts are linked with nothing, so all of them stay. Ids of any type; a null id comes after all
    others, and rows that share an id or have none come in the order in which they were first read, so exactly one row
    of each group stays.
    """
    rows, name, plain = row_keys(docs, id_col)
    src = rows.select(F.col(name).alias("key"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = _grouped(src, similar)
    if plain:
        keep = out.where("comp is null or comp = key").select("key")
    else:
        order = F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
        keep = out.groupBy(F.coalesce("comp", "key").alias("comp")).agg(order.alias("key")).select("key")
    return rows.join(keep.withColumnRenamed("key", name), name, "left_semi").select(*docs.columns)
