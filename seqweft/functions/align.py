"""Alignments, coordinate lifting and variant folding: sequential algorithms in Arrow-batched UDFs, one row at a time inside."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Cells of the tables that pairs of short strings share at once; longer pairs go one by one, in bands.
CELLS = 1 << 21
_FAR = 1 << 29


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class _Band:
    """The table of a pair in the diagonals that an alignment of cost t can reach; one row at a time, by diagonal."""

    def __init__(self, r: np.ndarray, h: np.ndarray, t: int):
        n, m = len(r), len(h)
        more = (t - abs(m - n)) // 2
        self.lo, hi = min(0, m - n) - more, max(0, m - n) + more
        self.r, self.n, self.m, self.width = r, n, m, hi - self.lo + 1
        self.h = np.concatenate([np.full(max(0, -self.lo), 0xFFFFFFFF, np.uint32), h, np.full(max(0, n + hi - m) + 1, 0xFFFFFFFF, np.uint32)])
        self.shift = max(0, -self.lo) + self.lo  # where diagonal 0 of row 0 begins in h
        self.slope = np.arange(self.width, dtype=np.int32)

    def first(self) -> np.ndarray:
        j = self.slope + self.lo
        return np.where((j >= 0) & (j <= self.m), j, _FAR).astype(np.int32)

    def next(self, above: np.ndarray, i: int, moves: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Row i from row i - 1 and, with moves, what led to each cell: 0 both letters, 1 a deletion, 2 an insertion."""
        at = self.shift + i - 1
        both = above + (self.h[at : at + self.width] != self.r[i - 1])
        up = np.append(above[1:], np.int32(_FAR)) + np.int32(1)
        row = np.minimum(both, up)
        left, right = max(0, -(i + self.lo)), self.m - i - self.lo + 1  # columns outside of the table
        row[:left] = _FAR
        row[max(0, right) :] = _FAR
        row -= self.slope
        np.minimum.accumulate(row, out=row)  # insertions run along the row
        row += self.slope
        row[:left] = _FAR
        row[max(0, right) :] = _FAR
        if not moves:
            return row, None
        if left:
            both[:left] = _FAR + 1
        if left < self.width and i + self.lo <= 0:
            both[left] = _FAR + 1  # no letter stands before column 0
        return row, np.where(row == both, 0, np.where(row == up, 1, 2)).astype(np.uint8)


def align(ref: str, hyp: str) -> tuple[int, str]:
    """(distance, ops) of a unit-cost global alignment; on ties a match or substitution, then a deletion, then an insertion.

    Diagonals are tried that hold all alignments of a cost of at most t, for twice as large a t until the distance is
    within it, so alike strings cost their length times their distance. Each k-th row is kept, with k the root of the rows;
    the way back makes the rows between two kept ones again. Memory is the root of the length times the band's width:
    some 110 MB for two unlike strings of 50,000 letters.
    """
    r, h = _codes(ref), _codes(hyp)
    n, m = len(r), len(h)
    t = max(abs(n - m), 32)
    while True:
        band = _Band(r, h, t)
        every = max(1, int(np.sqrt(n)))
        kept = [row := band.first()]
        for i in range(1, n + 1):
            row, _ = band.next(row, i)
            if i % every == 0:
                kept.append(row)
        distance = int(row[m - n - band.lo])
        if distance <= t:
            break
        t = min(2 * t, n + m)
    ops, i, j = bytearray(), n, m
    while i:
        base = (i - 1) // every
        del kept[base + 1 :]
        row, led = kept[base], []
        for k in range(base * every + 1, i + 1):
            row, moves = band.next(row, k, True)
            led.append(moves)
        while i > base * every:
            move = led[i - 1 - base * every][j - i - band.lo]
            if move == 0:
                ops.append(77 if r[i - 1] == h[j - 1] else 83)
                i, j = i - 1, j - 1
            elif move == 1:
                ops.append(68)
                i -= 1
            else:
                ops.append(73)
                j -= 1
    ops.extend(b"I" * j)
    ops.reverse()
    return distance, ops.decode()


def _align_many(pairs: list[tuple[str, str]]) -> list[tuple[int, str]]:
    """align() of pairs of about one size, by one padded table: rows of all pairs at once, and all ways back at once."""
    size = np.array([(len(a), len(b)) for a, b in pairs])
    n, m = np.maximum(size.max(0), 1)
    r, h = np.full((len(pairs), n), 0xFFFFFFFF, np.uint32), np.full((len(pairs), m), 0xFFFFFFFE, np.uint32)
    for k, (a, b) in enumerate(pairs):
        r[k, : len(a)], h[k, : len(b)] = _codes(a), _codes(b)
    slope = np.arange(m + 1, dtype=np.int32)
    led = np.full((n + 1, len(pairs), m + 1), 2, np.uint8)
    led[:, :, 0] = 1
    row = np.broadcast_to(slope, (len(pairs), m + 1))
    distance = np.where(size[:, 0] == 0, size[:, 1], 0)
    for i in range(1, n + 1):
        both = row[:, :-1] + (h != r[:, i - 1 : i])
        up = row + np.int32(1)
        row = up.copy()
        np.minimum(row[:, 1:], both, out=row[:, 1:])
        row = np.minimum.accumulate(row - slope, 1) + slope
        led[i, :, 1:] = np.where(row[:, 1:] == both, 0, np.where(row[:, 1:] == up[:, 1:], 1, 2))
        ends = np.flatnonzero(size[:, 0] == i)
        distance[ends] = row[ends, size[ends, 1]]
    who, i, j = np.arange(len(pairs)), size[:, 0].copy(), size[:, 1].copy()
    ops = np.zeros((len(pairs), n + m), np.uint8)
    step = 0
    while len(who := who[(i[who] > 0) | (j[who] > 0)]):
        a, b = i[who], j[who]
        move = np.where(a > 0, led[a, who, b], 2)
        same = r[who, np.maximum(a - 1, 0)] == h[who, np.maximum(b - 1, 0)]
        ops[who, step] = np.where(move == 0, np.where(same, 77, 83), np.where(move == 1, 68, 73))
        i[who] -= move < 2
        j[who] -= move != 1
        step += 1
    return [(int(d), o[o > 0][::-1].tobytes().decode()) for d, o in zip(distance, ops, strict=True)]


def align_pairs(refs: list[str], hyps: list[str]) -> list[tuple[int, str]]:
    """align() of each pair; short ones together by size, long ones alone."""
    out: list = [None] * len(refs)
    cells = [(len(a) + 1) * (len(b) + 1) for a, b in zip(refs, hyps, strict=True)]
    order = sorted(range(len(refs)), key=lambda k: (len(refs[k]), len(hyps[k])))
    held: list[int] = []
    n = m = 0
    for k in [*order, None]:
        wide, high = (max(n, len(refs[k])), max(m, len(hyps[k]))) if k is not None else (0, 0)
        if held and (k is None or (len(held) + 1) * (wide + 1) * (high + 1) > CELLS):
            for x, found in zip(held, _align_many([(refs[x], hyps[x]) for x in held]), strict=True):
                out[x] = found
            held, n, m = [], 0, 0
        if k is not None:
            if cells[k] > CELLS // 16:
                out[k] = align(refs[k], hyps[k])
            else:
                held.append(k)
                n, m = max(n, len(refs[k])), max(m, len(hyps[k]))
    return out


def _stats(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    rows = align_pairs([r or "" for r in ref], [h or "" for h in hyp])
    return pd.DataFrame({"distance": [d for d, _ in rows], "length": [len(o) for _, o in rows], "matches": [o.count("M") for _, o in rows], "ops": [o for _, o in rows]})


def alignment_stats(ref, hyp) -> Column:
    """struct(distance, length, matches, ops) of two string columns."""
    return F.pandas_udf(_stats, "distance int, length int, matches int, ops string")(ref, hyp)


def _masked(ops: pd.Series, mask: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if o is None or m is None else masked_stats(o, m) for o, m in zip(ops, mask, strict=True)]
    return pd.DataFrame(rows, columns=["matches", "distance", "letters"], dtype="Int64")


def masked_alignment_stats(ops, mask) -> Column:
    """struct(matches, distance, letters) of alignment ops and an array<boolean> over the reference; nulls give nulls."""
    return F.pandas_udf(_masked, "matches long, distance long, letters long")(ops, mask)


def masked_stats(ops: str, mask) -> tuple[int, int, int]:
    """(matches, distance, hypothesis letters) at masked reference places; an insertion belongs to the place before it."""
    at, last = 0, -1
    matches = distance = letters = 0
    for o in ops:
        if o != "I":
            last, at = at, at + 1
        if 0 <= last < len(mask) and mask[last]:
            matches += o == "M"
            distance += o != "M"
            letters += o != "D"
    return matches, distance, letters


def indel_distance(a: str, b: str) -> int:
    """n + m - 2 * longest common subsequence, without regard to case."""
    a, b = a.lower(), b.lower()
    longest = np.zeros(len(b) + 1, np.int64)
    codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    for x in a:  # a row of the table at once: the best of above, or diagonal and one, runs on along the row
        free = longest.copy()
        np.maximum(free[1:], longest[:-1] + (codes == ord(x)), out=free[1:])
        longest = np.maximum.accumulate(free)
    return len(a) + len(b) - 2 * int(longest[-1])


def _indels(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def indel_distances(a, b) -> Column:
    return F.pandas_udf(_indels, "int")(a, b)


def lift(cigar: list[tuple[str, int]], ref_start: int, start: int, end: int, stop_at_clip: bool = False) -> tuple[int, int]:
    """[qs, qe) of a read for the reference span [start, end): the first places at or after each end; clips count as read letters.

    With stop_at_clip a soft clip after the span has begun ends the walk.
    """
    q, r = 0, ref_start
    begun, qs, qe = False, 0, None
    for op, n in cigar:
        on_q, on_r = op in "MIS=X", op in "MDN=X"
        if op == "S" and stop_at_clip and begun:
            break
        if on_r:
            if not begun and r + n > start:
                begun = True
                qs = q + (max(0, start - r) if on_q else 0)
            if qe is None and r + n > end:
                qe = q + (max(0, end - r) if on_q else 0)
        q, r = q + n * on_q, r + n * on_r
        if qe is not None:
            break
    qe = q if qe is None else qe
    return qs, max(qs, qe)


def lifted(cigar, ref_start, start, end, stop_at_clip: bool = False) -> Column:
    """struct(qs, qe) of columns: cigar as array<struct<op, len>>, 0-based reference start, span; nulls give nulls."""

    def run(cigar: pd.Series, ref_start: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
        rows = []
        for c, *x in zip(cigar, ref_start, start, end, strict=True):
            rows.append((None, None) if c is None or any(map(pd.isna, x)) else lift([(y["op"], y["len"]) for y in c], *map(int, x), stop_at_clip))
        return pd.DataFrame(rows, columns=["qs", "qe"], dtype="Int32")

    return F.pandas_udf(run, "qs int, qe int")(cigar, ref_start, start, end)


def errors_in_window(cigar: Column, start: Column, end: Column) -> Column:
    """Letters of I, D and X ops once `start` letters of ops are passed, until the window's length is covered by whole ops.

    An op that ends just where the window starts counts as a whole.
    """
    begin = F.struct(F.greatest(start, F.lit(0)).cast("long").alias("skip"), F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("bad"))

    def step(a, x):
        n = x["len"].cast("long")
        rest = F.when(a["skip"] == n, n).otherwise(F.greatest(n - a["skip"], F.lit(0).cast("long")))
        used = F.when(a["seen"] < end - start, rest).otherwise(F.lit(0).cast("long"))
        bad = F.when(x["op"].isin("I", "D", "X"), used).otherwise(F.lit(0).cast("long"))
        return F.struct(F.greatest(a["skip"] - x["len"], F.lit(0).cast("long")).alias("skip"), (a["seen"] + used).alias("seen"), (a["bad"] + bad).alias("bad"))

    return F.aggregate(cigar, begin, step, lambda a: a["bad"])


def spike_in(ref: str, first: int, variants: list[tuple[int, str, str]], empty_alt: bool = False) -> str:
    """A reference slice that begins at the 1-based place `first`, with variants (pos, REF, ALT) put in from left to right.

    Both alleles are cut by the letters that REF has beyond the slice's ends (ALT only if it has as many); a variant that overlaps the edit before, or whose REF differs, is left out, and
    so is an empty ALT unless empty_alt.
    """
    out, done = [], 0
    for pos, r, a in variants:
        at = pos - first
        if a == "*" or not r or not a and not empty_alt:
            continue
        if at < 0:
            r, a, at = r[-at:], a[-at:] if len(a) >= -at else a, 0
        over = at + len(r) - len(ref)
        if 0 < over < len(r):
            r, a = r[:-over], a[:-over] if len(a) >= over else a
        if not r or not a and not empty_alt or at < done or ref[at : at + len(r)].upper() != r.upper():
            continue
        out += [ref[done:at], a]
        done = at + len(r)
    return "".join(out) + ref[done:]


def spiked(ref, first, variants, empty_alt: bool = False) -> Column:
    """Haplotypes of columns: slice, its first place, array<struct<pos, ref, alt>> in order; a null slice or place gives null, null variants none."""

    def run(ref: pd.Series, first: pd.Series, variants: pd.Series) -> pd.Series:
        out = []
        for r, f, v in zip(ref, first, variants, strict=True):
            known = [(x["pos"], x["ref"], x["alt"]) for x in (v if v is not None else ()) if x and None not in (x["pos"], x["ref"], x["alt"])]
            out.append(None if r is None or pd.isna(f) else spike_in(r, int(f), known, empty_alt))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(ref, first, variants)
