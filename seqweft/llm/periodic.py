"""Maximal runs of repeated word sequences, by branching tandem repeats of each text's suffix tree.

The tree is held as arrays: leaves in suffix order, and for each border of two neighbouring leaves the depth of the
node that parts them (the binary form of the tree: a node with several children is a chain of borders of one depth).
Two leaves q words apart that a node of depth q parts are a branching tandem repeat: a square that cannot be shifted to
the right. Each node looks at the leaves of its smaller half only and asks whether the leaf q words before or behind
stands in the other half, so all nodes together look at n log n leaves. Every run ends with exactly one such square of
its own period, so shifting (rotating) squares to the left and merging those of one end and one root gives all runs.

Texts of an Arrow column are worked on together: words of different texts are different letters, so no node has leaves
of two texts. Numbers for words come from an exact dictionary, not from hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import Words, coded, pieces

#: Leaves that are looked at in one numpy step (a memory bound; results do not depend on it).
STEP = 1 << 21


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of key, its places where a new value begins, and each element's rank (the place where its value begins)."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(len(key), np.int64)
    begins = np.flatnonzero(new)
    rank[order] = np.repeat(begins, np.diff(np.append(begins, len(key))))
    return order, new, rank


def suffix_tree(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaves in suffix order, each suffix's place, depths): depths[k] parts leaf k from leaf k + 1.

    Prefix doubling: ranks by the first 2^t letters; only suffixes that share their rank with another are sorted again.
    Depths come from the ranks of all rounds, longest first.
    """
    n = len(letters)
    order, new, rank = _dense(letters)
    rounds, size = [rank], 1
    while True:
        starts = np.flatnonzero(new)
        length = np.diff(np.append(starts, n))
        tied = np.flatnonzero(np.repeat(length, length) > 1)  # places in order, still undecided
        if not len(tied):
            break
        leaf = order[tied]
        behind = np.minimum(leaf + size, n)
        ahead = np.append(rank, -1)[behind]
        by = np.lexsort((ahead, rank[leaf]))
        leaf, ahead, group = leaf[by], ahead[by], rank[leaf][by]
        order = order.copy()
        order[tied] = leaf
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])
        new = new.copy()
        new[tied] = fresh
        begins = np.flatnonzero(fresh)
        rank = rank.copy()
        rank[leaf] = np.repeat(tied[begins], np.diff(np.append(begins, len(tied))))
        rounds.append(rank)
        size *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # depths: neighbours whose first words differ are parted at the root
    depth = np.zeros(max(0, n - 1), np.int64)
    k = np.flatnonzero(rounds[0][order[1:]] == rounds[0][order[:-1]])
    a, b = order[k], order[k + 1]
    d = np.zeros(len(k), np.int64)
    for t in range(len(rounds) - 1, -1, -1):
        r, jump = rounds[t], 1 << t
        inside = np.flatnonzero(np.maximum(a, b) + d < n)
        same = inside[r[a[inside] + d[inside]] == r[b[inside] + d[inside]]]
        d[same] += jump
    depth[k] = d
    return order, place, depth


def _reach(depth: np.ndarray, strict: bool) -> np.ndarray:
    """For each border of some depth the nearest border before it with a smaller depth (or, not strict, one as small), or -1; by jumping."""
    n = len(depth)
    left = np.arange(-1, n - 1)
    todo = np.flatnonzero(depth > 0)
    while len(todo):
        at = left[todo]
        far = at >= 0
        todo, at = todo[far], at[far]
        on = depth[at] >= depth[todo] if strict else depth[at] > depth[todo]
        todo, at = todo[on], at[on]
        left[todo] = left[at]
    return left


def branching_repeats(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, q) of each square of two times q letters that cannot be shifted to the right."""
    n = len(letters)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, place, depth = suffix_tree(letters)
    node = np.flatnonzero(depth > 0)
    first = _reach(depth, True)[node] + 1  # leaves first..node are the left half, node + 1..last the right one
    last = len(depth) - 1 - _reach(depth[::-1], False)[::-1][node]
    small_left = node - first + 1 <= last - node
    begin = np.where(small_left, first, node + 1)
    size = np.where(small_left, node - first + 1, last - node)
    lo, hi = np.where(small_left, node + 1, first), np.where(small_left, last, node)  # the larger half
    total = np.cumsum(size)
    starts, periods = [], []
    at = 0
    while at < len(node):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        count = size[at:to]
        owner = np.repeat(np.arange(at, to), count)
        leaf = order[np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begin[owner]]
        q = depth[node[owner]]
        for partner, low in ((leaf + q, leaf), (leaf - q, leaf - q)):
            ok = np.flatnonzero((partner >= 0) & (partner < n))
            p = place[partner[ok]]
            ok = ok[(p >= lo[owner[ok]]) & (p <= hi[owner[ok]])]
            starts.append(low[ok])
            periods.append(q[ok])
        at = to
    return np.concatenate(starts) if starts else np.zeros(0, np.int64), np.concatenate(periods) if periods else np.zeros(0, np.int64)


def _leftmost(letters: np.ndarray, start: int, q: int, least: int) -> int:
    """How far a square with period q can be shifted to the left, not beyond least; steps double."""
    step = 16
    while start > least:
        lo = max(least, start - step)
        unlike = np.flatnonzero(letters[lo:start] != letters[lo + q : start + q])
        if len(unlike):
            return lo + int(unlike[-1]) + 1
        start, step = lo, 2 * step
    return start


def maximal_runs(letters: np.ndarray, first: np.ndarray, shortest: int = 12) -> list[list[tuple[int, int, int]]]:
    """Of each text (letters first[r] .. first[r + 1]) its runs (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    start, q = branching_repeats(letters)
    if not len(start):
        return out
    end = start + 2 * q
    by = np.lexsort((q, end))
    start, q, end = start[by], q[by], end[by]
    row = np.searchsorted(first, start, "right") - 1
    here, roots = -1, []
    for s, p, e, r in zip(start.tolist(), q.tolist(), end.tolist(), row.tolist(), strict=True):
        if e != here:
            here, roots = e, []
        if any(p % root == 0 and begin <= s for root, begin in roots):
            continue  # a power of a shorter root, whose run ends here too
        begin = _leftmost(letters, s, p, int(first[r]))
        roots.append((p, begin))
        if e - begin >= max(shortest, 2 * p):
            out[r].append((begin - int(first[r]), e - begin, p))
    for runs in out:
        runs.sort(key=lambda x: (x[0], x[2]))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 12, repeat: Callable[[object, int], tuple[int, int] | None] | None = None, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_runs; start, length, period, exponent_milli of the longest run; runs_sha256, collapsed_sha256 and, with_text, runs (all of them) and collapsed.

    A run is a stretch of words with smallest period q, of at least max(shortest, 2 q) words, that no neighbouring word
    extends. Of runs of one length the longest is the one that starts first, then the one with the smallest period.
    Collapsed texts keep the first q words of each run and the words outside of runs. repeat(id, words) may give (a, p):
    words from a on become repeats of the p words from a on, before anything is searched.

    Null and empty texts have no words, no runs, four nulls and the digests of nothing. Rows are searched alone: null and
    repeated ids and repeated rows are rows as others; other columns are ignored. A row's whole text is searched in one
    task, in memory of some 200 bytes a word and text column of a few MB.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches):
        for b in batches:
            ids = b.column("doc_id")
            for at, data, offs in pieces(b.column("text")):
                words = Words(data, offs)
                code, row, first = coded(data, words)[0], words.row(), words.first
                source = np.arange(len(code))
                who = ids.slice(at, len(offs) - 1).to_pylist() if repeat else []
                changed = [False] * (len(offs) - 1)
                for r in range(len(who)):
                    n = int(first[r + 1] - first[r])
                    change = repeat(who[r], n) if n else None
                    if change:
                        changed[r] = True
                        a, p = change
                        source[first[r] + a : first[r + 1]] = first[r] + a + np.arange(n - a) % p
                letters = code[source] + row * (len(code) + 1)
                found = maximal_runs(letters, first, shortest)
                raw = data.tobytes()
                n_runs, best, digest, kept = [], [], [], []
                for r, runs in enumerate(found):
                    n_runs.append(len(runs))
                    best.append(max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None))
                    digest.append(hashlib.sha256("".join([f"{s},{n},{p}\n" for s, n, p in runs]).encode()).hexdigest())
                    mine = raw[offs[r] : offs[r + 1]].split()
                    inside = source[first[r] : first[r + 1]] - first[r]
                    if runs:
                        edge = np.zeros(len(mine) + 1, np.int64)
                        for s, n, p in runs:
                            edge[s + p] += 1
                            edge[s + n] -= 1
                        inside = inside[np.cumsum(edge)[:-1] == 0]
                        mine = [mine[k] for k in inside.tolist()]
                    elif changed[r]:
                        mine = [mine[k] for k in inside.tolist()]
                    kept.append(b" ".join(mine))
                cols = [
                    ids.slice(at, len(found)), pa.array(n_runs, pa.int64()),
                    *(pa.array([x and x[k] for x in best], pa.int64()) for k in range(3)),
                    pa.array([x and 1000 * x[1] // x[2] for x in best], pa.int64()),
                    pa.array(digest, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                ]
                if with_text:
                    cols += [
                        pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in runs] for runs in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"][: len(cols)])

    kind = dict(src.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return src.mapInArrow(work, schema + ", runs array<struct<start:long,length:long,period:long>>, collapsed string" * with_text)
