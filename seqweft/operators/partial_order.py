"""One sequence for the reads of a window by partial-order alignment; tasks advance many windows together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered

#: Columns that a row of the alignment has on each side of where its best score is expected: so many, and this share of the read.
BAND = (10, 0.01)
#: Cells of tables that are held at once, 2 bytes each, 4 where scores need them (one window may need more), and squared letters of a task.
CELLS, WORK = 48_000_000, 400_000_000
#: Letters of the windows that are advanced together; so many rows of a level are filled at once no slower than each by itself.
LETTERS, ROWS = 400_000, 14
_NEVER = -(1 << 29)


class Graph:
    """Letters, the weights of the edges into each, and which letters stand at one place."""

    def __init__(self):
        self.base: list[str] = []
        self.before: list[dict[int, int]] = []
        self.aligned: list[dict[str, int] | None] = []

    def node(self, letter: str) -> int:
        self.base.append(letter)
        self.before.append({})
        self.aligned.append(None)
        return len(self.base) - 1

    def thread(self, path: list[int], weight: int) -> None:
        for a, b in zip(path, path[1:], strict=False):
            self.before[b][a] = self.before[b].get(a, 0) + weight

    def order(self) -> list[int]:
        """Nodes, each behind all before it: depth first, smaller numbers first."""
        seen = bytearray(len(self.base))
        before, out = self.before, []
        for root in range(len(before)):
            if seen[root]:
                continue
            seen[root] = 1
            stack = [(root, iter(sorted(before[root])))]
            while stack:
                n, it = stack[-1]
                for p in it:
                    if not seen[p]:
                        seen[p] = 1
                        stack.append((p, iter(sorted(before[p]))))
                        break
                else:
                    out.append(n)
                    stack.pop()
        return out

    def ends(self) -> list[int]:
        inner = {p for b in self.before for p in b}
        return [n for n in range(len(self.base)) if n not in inner]

    def heaviest(self, order: list[int] | None = None) -> str:
        most, back = [0] * len(self.base), [-1] * len(self.base)
        for n in self.order() if order is None else order:
            top = None
            for p, w in self.before[n].items():
                this = (most[p] + w, w, -p)
                if top is None or this > top:
                    top = this
            if top:
                most[n], back[n] = top[0], -top[2]
        at = most.index(max(most)) if most else -1
        out = []
        while at != -1:
            out.append(self.base[at])
            at = back[at]
        return "".join(reversed(out))


# Scores in both tables are less gap * column, so that insertions cost nothing and run along a row as its running maximum.


def _banded(g: Graph, level: np.ndarray, read: str, width: int, score: tuple[int, int, int]):
    """One window's table in the band, a row at a time: (node, column) -> score. Rows go `width` beyond the peaks of those before them."""
    match, mismatch, gap = score
    m = len(read)
    codes = np.frombuffer(read.encode("utf-32-le"), np.uint32)
    earn = {c: np.where(codes == ord(c), np.int32(match - gap), np.int32(mismatch - gap)) for c in set(g.base)}
    count = len(g.base)
    first, peak = [0] * (count + 1), [0] * (count + 1)  # the last is the start
    rows: list = [None] * count + [np.zeros(min(m, width) + 1, np.int32)]
    slope = gap * np.arange(m + 1, dtype=np.int32)
    cells = np.empty(m + 2, np.int32)
    base, before, maximum, running, start = g.base, g.before, np.maximum, np.maximum.accumulate, (-1,)
    for n in level.argsort(kind="stable").tolist():
        parents = before[n] or start
        if len(parents) == 1:
            (p,) = parents
            low = high = peak[p]
        else:
            tops = [peak[p] for p in parents]
            low, high = min(tops), max(tops)
        lo, hi = max(0, low + 1 - width), min(m, high + 1 + width)
        above = cells[: hi - lo + 2]  # columns lo - 1 to hi
        above.fill(_NEVER)
        for p in parents:
            x, row = lo - 1 - first[p], rows[p]
            part = row[max(x, 0) : x + len(above)]
            at = max(-x, 0)
            if len(parents) == 1:
                above[at : at + len(part)] = part
            else:
                into = above[at : at + len(part)]
                maximum(into, part, out=into)
        free = above[1:] + gap
        if lo:
            step = earn[base[n]][lo - 1 : hi]
            maximum(free, step + above[:-1], out=free)
        else:
            inner = free[1:]
            maximum(inner, earn[base[n]][:hi] + above[1:-1], out=inner)
        running(free, out=free)
        first[n], rows[n] = lo, free
        peak[n] = lo + int((free + slope[lo : hi + 1]).argmax())

    def at_column(n: int, j: int) -> int:
        x = j - first[n]
        return int(rows[n][x]) + gap * j if 0 <= x < len(rows[n]) else _NEVER

    return at_column


def _level(g: Graph) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    before, level = g.before, [0] * len(g.base)
    for n in g.order():
        for p in before[n]:
            if level[p] >= level[n]:
                level[n] = level[p] + 1
    return np.array(level, np.int64), np.fromiter(map(len, before), np.int64, len(before)), np.fromiter((p for b in before for p in b), np.int64)


def _levels(graphs: list[Graph]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each graph (steps of the longest way to each node, its number of parents, all parents); a step in all graphs at once."""
    if len(graphs) < 5:
        return [_level(g) for g in graphs]
    sizes = [len(g.base) for g in graphs]
    starts = np.cumsum([0, *sizes])
    count = int(starts[-1])
    degree = np.fromiter((len(b) for g in graphs for b in g.before), np.int64, count)
    own = [np.fromiter((p for b in g.before for p in b), np.int64) for g in graphs]
    source = np.concatenate([p + o for p, o in zip(own, starts, strict=False)])
    into = np.repeat(np.arange(count), degree)[np.argsort(source, kind="stable")]
    out = np.bincount(source, minlength=count)
    first = np.cumsum(out) - out
    left, level, mark = degree.copy(), np.zeros(count, np.int64), np.zeros(count, np.int64)
    now, step = np.flatnonzero(degree == 0), 0
    while len(now):
        level[now] = step
        step += 1
        many = out[now]
        ends = many.cumsum()
        nodes = into[np.repeat(first[now] - ends + many, many) + np.arange(ends[-1])]
        np.subtract.at(left, nodes, 1)
        nodes = nodes[left[nodes] == 0]
        turn = np.arange(len(nodes))
        mark[nodes] = turn
        now = nodes[mark[nodes] == turn]  # each once
    return [(level[x:y], degree[x:y], p) for x, y, p in zip(starts, starts[1:], own, strict=False)]


class _Rows:
    """The tables of many windows as rows of one: the windows' starts, then all nodes by level, so that a level is filled at once.

    Jobs are (graph, what _levels gives of it, read). Rows of a level with more parents come first: its k-th parents, which
    stand together, belong to its first rows.
    """

    def __init__(self, jobs: list[tuple[Graph, tuple, str]], score: tuple[int, int, int]):
        match, mismatch, self.gap = score
        many = len(jobs)
        sizes = np.array([len(g.base) for g, *_ in jobs])
        window = np.repeat(np.arange(many), sizes)
        level, degree = (np.concatenate([x[i] for _, x, _ in jobs]) for i in (0, 1))
        order = np.lexsort((-degree, level))
        self.count = many + len(order)
        row = np.empty(len(order), np.int64)
        row[order] = np.arange(many, self.count)
        offsets = np.cumsum(sizes) - sizes
        root = np.flatnonzero(degree == 0)
        child = np.concatenate([np.repeat(np.arange(len(order)), degree), root])
        parent = np.concatenate([row[np.concatenate([x[2] + o for (_, x, _), o in zip(jobs, offsets, strict=True)])], window[root]])
        slot = np.concatenate([np.arange(len(child) - len(root)) - np.repeat(np.cumsum(degree) - degree, degree), np.zeros(len(root), np.int64)])
        dealt = np.lexsort((row[child], slot, level[child]))
        self.parent = parent[dealt]
        most = int(slot.max()) + 1
        cell, first = np.unique((level[child] * most + slot)[dealt], return_index=True)
        self.steps: list[tuple[int, int, list[tuple[int, int]]]] = []  # (first row, row behind the last, where parents of each place stand)
        at = many
        for c, u, v in zip(cell.tolist(), first.tolist(), [*first[1:].tolist(), len(dealt)], strict=True):
            if c % most == 0:
                self.steps.append((at, at + v - u, []))
                at += v - u
            self.steps[-1][2].append((u, v))
        self.place = [[*row[o : o + n].tolist(), b] for b, (o, n) in enumerate(zip(offsets.tolist(), sizes.tolist(), strict=True))]  # place[-1] is the start's row
        self.window = np.concatenate([np.arange(many), window[order]])
        self.letters = [len(r) for *_, r in jobs]
        self.wide = max(self.letters) + 1
        points = [np.frombuffer("".join(g.base).encode("utf-32-le"), np.uint32).astype(np.int64) for g, *_ in jobs]
        keys, self.letter = np.unique((window << 32 | np.concatenate(points))[order], return_inverse=True)
        self.letter = np.concatenate([np.zeros(many, np.int64), self.letter])
        up, down = max(match - self.gap, mismatch - self.gap, 0), min(self.gap, mismatch - self.gap, 0)
        short = up * self.wide - down * (len(self.steps) + 2) < 31_000 and down > -500
        self.kind, self.never = (np.int16, -32_000) if short else (np.int32, _NEVER)
        self.unreached = self.never + up * self.wide  # nothing that begins outside a band gets above it
        # what a step into each column earns, by window and letter; column 0 has no such step
        reads = np.full((many, self.wide), -1, np.int64)
        for b, (*_, r) in enumerate(jobs):
            reads[b, 1 : len(r) + 1] = np.frombuffer(r.encode("utf-32-le"), np.uint32)
        self.earn = np.where(reads[keys >> 32] == (keys & 0xFFFFFFFF)[:, None], self.kind(match - self.gap), self.kind(mismatch - self.gap))

    def whole(self) -> list:
        """Of each window (node, column) -> score."""
        t, parent, gap = np.empty((self.count, self.wide), self.kind), self.parent, self.gap
        t[: len(self.place)] = 0
        earn = np.ascontiguousarray(self.earn[:, 1:])
        for s, e, places in self.steps:
            u, v = places[0]
            above = t[parent[u:v]]
            for u, v in places[1:]:
                np.maximum(above[: v - u], t[parent[u:v]], out=above[: v - u])
            step = earn[self.letter[s:e]]
            step += above[:, :-1]
            above += gap
            np.maximum(above[:, 1:], step, out=above[:, 1:])
            np.maximum.accumulate(above, 1, out=t[s:e])
        cells, gap = memoryview(t.reshape(-1)), self.gap

        def reader(b: int):
            base = [r * self.wide for r in self.place[b]]
            return lambda n, j: cells[base[n] + j] + gap * j

        return [reader(b) for b in range(len(self.place))]

    def banded(self, widths: list[int]) -> list | None:
        """The same in the bands: rows go the window's width beyond the peaks of those before them; cells outside are `never`.

        None where many windows' rows have more than CELLS cells.
        """
        never, gap, parent, wide = self.never, self.gap, self.parent, self.wide
        earn = np.concatenate([self.earn.reshape(-1), self.earn[0]])
        beyond, last = np.array(widths)[self.window] + 1, np.array(self.letters)[self.window]
        # cells of all rows behind one another, each with one before and one behind it that is `never`
        size = (last[: len(self.place)] + 1).clip(max=beyond[: len(self.place)])
        flat = np.full(max(int(size.sum()) + 2 * len(size), 3 * self.count * max(widths)), never, self.kind)
        first, length, base, peak = (np.zeros(self.count, np.int64) for _ in range(4))  # of a row: its first column, its columns, where that is, its best
        length[: len(size)] = size
        base[: len(size)] = np.cumsum(size + 2) - size - 1
        for x, n in zip(base.tolist(), size.tolist(), strict=False):
            flat[x : x + n] = 0
        used = int(size.sum()) + 2 * len(size)
        earned = self.letter * wide
        columns, slope = np.arange(wide + 1), gap * np.arange(wide, dtype=np.int32)
        for s, e, places in self.steps:
            ups = [parent[u:v] for u, v in places]
            low = high = peak[ups[0]]
            if len(ups) > 1:
                high = low.copy()
                for p in ups[1:]:
                    tops = peak[p]
                    np.minimum(low[: len(p)], tops, out=low[: len(p)])
                    np.maximum(high[: len(p)], tops, out=high[: len(p)])
            width = beyond[s:e]
            lo, hi = np.maximum(low - width + 2, 0), np.minimum(high + width, last[s:e])
            long = hi - lo + 1
            n, even = int(long.max()), int(long.min())
            above = None
            for p in ups:  # from a column before on
                cells = columns[: n + 1] + (lo[: len(p)] - first[p] - 1)[:, None]
                np.maximum(cells, -1, out=cells)
                np.minimum(cells, length[p][:, None], out=cells)
                cells += base[p][:, None]
                if above is None:
                    above = flat.take(cells, mode="clip")
                else:
                    np.maximum(above[: len(p)], flat.take(cells, mode="clip"), out=above[: len(p)])
            free = above[:, 1:] + gap
            step = np.ndarray((earn.size - n + 1, n), earn.dtype, earn, 0, (earn.itemsize,) * 2)[earned[s:e] + lo]  # [x] is earn[x : x + n]
            step += above[:, :-1]
            np.maximum(free, step, out=free)
            np.maximum(free, never, out=free)
            np.maximum.accumulate(free, 1, out=free)
            if even < n:
                np.copyto(free, never, where=columns[:n] >= long[:, None])
            if used + (e - s) * (n + 2) > len(flat):
                if len(flat) > CELLS and len(self.place) > 1:
                    return None
                flat = np.concatenate([flat, np.full((e - s) * (n + 2) + len(flat) // 2, never, self.kind)])
            flat[used : used + (e - s) * (n + 2)].reshape(e - s, n + 2)[:, 1:-1] = free
            base[s:e] = np.arange(used + 1, used + (e - s) * (n + 2), n + 2)
            used += (e - s) * (n + 2)
            first[s:e], length[s:e] = lo, n
            peak[s:e] = (free + slope[:n]).argmax(1) + lo
        return [self._band_reader(b, flat, first, length, base) for b in range(len(self.place))]

    def _band_reader(self, b: int, flat: np.ndarray, first: np.ndarray, length: np.ndarray, base: np.ndarray):
        mine, cells, gap, never = self.place[b], memoryview(flat), self.gap, self.never
        first, length, base = first[mine].tolist(), length[mine].tolist(), base[mine].tolist()

        def at_column(n: int, j: int) -> int:
            x = j - first[n]
            return cells[base[n] + x] + gap * j if 0 <= x < length[n] else never + gap * j

        return at_column


def _trace(g: Graph, read: str, at_column, end: int, score: tuple[int, int, int]) -> list[int]:
    """The read's nodes along the best path: old ones where letters agree, new ones elsewhere."""
    match, mismatch, gap = score
    at, j, path = end, len(read), []
    here = at_column(at, j)
    while at != -1:
        parents = g.before[at]
        parents = sorted(parents) if len(parents) > 1 else list(parents) or [-1]
        c = read[j - 1] if j else None
        if j:
            step = here - (match if g.base[at] == c else mismatch)
            to = next((q for q in parents if at_column(q, j - 1) == step), None)
            if to is not None:
                same, group = at, g.aligned[at]
                if g.base[at] != c:
                    same = group.get(c) if group else None
                    if same is None:
                        same = g.node(c)
                        if group is None:
                            group = g.aligned[at] = {g.base[at]: at}
                        group[c] = same
                        g.aligned[same] = group
                path.append(same)
                at, j, here = to, j - 1, step
                continue
        to = next((q for q in parents if at_column(q, j) + gap == here), None)
        if to is not None:
            at, here = to, here - gap
        else:
            path.append(g.node(c))
            j -= 1
            here = at_column(at, j)
    path.extend(g.node(c) for c in reversed(read[:j]))
    return path[::-1]


def poa_sequences(windows: list[list[str]], match: int = 2, mismatch: int = -4, gap: int = -4, band: tuple[int, float] | None = BAND, weights: list[list[int]] | None = None) -> list[str]:
    """Of each window the heaviest path of the graph to which its reads are aligned one after the other, each against all before; '' without reads.

    Rows are banded around the column behind the best one of the rows before them. A read that the band does not bring to
    its end is aligned without it. A read counts as often as its weight. Windows do not affect one another: all
    nodes of a level, of all windows, are filled at once; few rows in bands one at a time, which is as fast. Memory: CELLS
    cells, or the nodes times the letters of one window's largest read, if that is more, and the graphs.
    """
    score = (match, mismatch, gap)
    many = weights or [[1] * len(w) for w in windows]
    reads = [[(r, n) for r, n in zip(w, c, strict=True) if r] for w, c in zip(windows, many, strict=True)]
    graphs = [Graph() for _ in windows]
    for g, mine in zip(graphs, reads, strict=True):
        if mine:
            g.thread([g.node(c) for c in mine[0][0]], mine[0][1])
    for turn in range(1, max(map(len, reads), default=0)):
        todo = sorted((b for b, mine in enumerate(reads) if len(mine) > turn), key=lambda b: len(reads[b][turn][0]))
        known = dict(zip(todo, _levels([graphs[b] for b in todo]), strict=True))

        def settle(part: list[int], unreached: int, tables: list, turn=turn) -> list[int]:
            """Threads reads along their best paths; returns the windows whose tables have none."""
            out = []
            for b, at_column in zip(part, tables, strict=True):
                g, (read, weight) = graphs[b], reads[b][turn]
                m = len(read)
                end = max(g.ends(), key=lambda n: (at_column(n, m), -n))
                if at_column(end, m) - gap * m > unreached:
                    g.thread(_trace(g, read, at_column, end, score), weight)
                else:
                    out.append(b)
            return out

        def made(part: list[int], turn=turn, known=known) -> _Rows:
            return _Rows([(graphs[b], known[b], reads[b][turn][0]) for b in part], score)

        rest, banded = ([], [todo]) if band else (todo, [])
        if sum(len(graphs[b].base) for b in todo) < ROWS * max(int(known[b][0].max()) for b in todo):
            for b in banded.pop() if banded else ():
                read = reads[b][turn][0]
                rest += settle([b], _NEVER // 2, [_banded(graphs[b], known[b][0], read, int(band[0] + band[1] * len(read)), score)])
        while banded:
            part = banded.pop()
            rows = made(part)
            tables = rows.banded([int(band[0] + band[1] * m) for m in rows.letters])
            if tables is None:
                half = len(part) // 2
                banded += [part[half:], part[:half]]
            else:
                rest += settle(part, rows.unreached, tables)
        for part in _parts(rest, [len(graphs[b].base) + 1 for b in rest], [len(reads[b][turn][0]) + 1 for b in rest]):
            rows = made(part)
            settle(part, rows.unreached, rows.whole())
    return [g.heaviest(level.argsort(kind="stable").tolist()) for g, (level, *_) in zip(graphs, _levels(graphs), strict=True)]


def _parts(items: list[int], rows: list[int], widths: list[int]) -> Iterator[list[int]]:
    """Runs of items, by rising width, whose rows, each as wide as the run's widest, have at most CELLS cells."""
    held, total = [], 0
    for b, n, w in zip(items, rows, widths, strict=True):
        if held and (total + n) * w > CELLS:
            yield held
            held, total = [], 0
        held.append(b)
        total += n
    if held:
        yield held


def poa_sequence(reads: list[str], match: int = 2, mismatch: int = -4, gap: int = -4, band: tuple[int, float] | None = BAND) -> str:
    """poa_sequences() of one window."""
    return poa_sequences([reads], match, mismatch, gap, band)[0]


def window_poa(reads: DataFrame, keys: list[str], order: str, seq: str, least: int = 1, unknown_as: str | None = None, depth: int | None = None, work: int = WORK) -> DataFrame:
    """(keys, n_reads, sequence): reads in their order; fewer than `least` give '', null and empty ones count but are not aligned.

    unknown_as: the letter that stands for all but A, C, G and T. depth: reads of a window beyond so many go in groups of
    that size, which may be the work of different tasks; the groups' sequences are then aligned in order, each with the
    weight of its reads, so a window of up to depth reads gives what it gives without groups. The number of tasks follows
    the squared letters, as the work does, not the bytes. Without depth a window's reads are one task's, in memory of
    poa_sequences() and of the reads.
    """
    letters = F.coalesce(F.col(seq), F.lit(""))
    rows = reads.select(*keys, F.col(order).alias("order_"), (F.regexp_replace(letters, "[^ACGT]", unknown_as) if unknown_as else letters).alias("seq_"), F.lit(1).cast("long").alias("n_reads"))
    if depth:
        rows = rows.withColumn("window_", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
        rows = ordered.numbered(rows, "window_", ["order_", "seq_"], "k_", 64 * depth).drop("window_").withColumn("group_", F.floor((F.col("k_") - 1) / F.lit(depth)))
        rows = _aligned(rows, [*keys, "group_"], work).select(*keys, F.col("group_").alias("order_"), F.col("sequence").alias("seq_"), "n_reads")
    out = _aligned(rows, keys, work)
    return out.withColumn("sequence", F.when(F.col("n_reads") >= least, F.col("sequence")).otherwise(""))


def _aligned(rows: DataFrame, keys: list[str], work: int) -> DataFrame:
    """(keys, n_reads, sequence) of rows (keys, order_, seq_, n_reads): each window in one task, tasks of about `work` squared letters."""
    total = rows.agg(F.sum(F.length("seq_").cast("double") * F.length("seq_"))).first()[0] or 0
    parts = min(max(int(total / work), rows.sparkSession.sparkContext.defaultParallelism), 1 << 16)
    kinds = dict(rows.dtypes)

    def run(batches):
        held: list[tuple] = []  # windows that are complete: (key, reads, weights)
        letters = 0

        def out():
            found = poa_sequences([w[1] for w in held], weights=[w[2] for w in held])
            columns = [pa.array([w[0][i] for w in held], types[i]) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([sum(w[2]) for w in held], pa.int64()), pa.array(found, pa.string())], [*keys, "n_reads", "sequence"])

        now, types = None, []
        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            for *key, text, n in zip(*(b.column(c).to_pylist() for c in (*keys, "seq_", "n_reads")), strict=True):
                if now is None or now[0] != key:
                    if now:
                        held.append(now)
                        letters += sum(map(len, now[1]))
                    if letters > LETTERS:
                        yield out()
                        held, letters = [], 0
                    now = (key, [], [])
                now[1].append(text)
                now[2].append(n)
        if now:
            held.append(now)
            yield out()

    dealt = rows.repartition(parts, *keys).sortWithinPartitions(*keys, "order_", "seq_")
    return dealt.select(*keys, "seq_", "n_reads").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_reads long, sequence string")
