"""Alignments in bands and in shared tables against the whole table of each pair: the same distance and the same ops."""

import random
import tracemalloc

import pytest

from seqweft.functions import align


def whole(a, b):
    """Ties: both letters, then a deletion, then an insertion."""
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, ops = len(a), len(b), ""
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            ops = ("M" if a[i] == b[j] else "S") + ops
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i, ops = i - 1, "D" + ops
        else:
            j, ops = j - 1, "I" + ops
    return cost[-1][-1], ops


def pairs(seed, n):
    rnd = random.Random(seed)
    out = [("", ""), ("", "ab"), ("ab", ""), ("é日", "e日"), ("a", "a")]
    for _ in range(n):
        letters = rnd.choice(["ab", "acgt", "abcdefghij"])
        a = [rnd.choice(letters) for _ in range(rnd.randint(0, 45))]
        b = list(a) if rnd.random() < 0.6 else [rnd.choice(letters) for _ in range(rnd.randint(0, 45))]
        for _ in range(rnd.randint(0, 8)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.choice([0, 1, 1, 9])] = rnd.choice([[], [rnd.choice(letters)]])
        out.append(("".join(a), "".join(b)))
    return out


@pytest.mark.parametrize("cells", [1 << 21, 2_000, 16])
def test_ops_of_the_whole_table(monkeypatch, cells):
    monkeypatch.setattr(align, "CELLS", cells)
    mine = pairs(cells, 500)
    want = [whole(a, b) for a, b in mine]
    assert align.align_pairs([a for a, _ in mine], [b for _, b in mine]) == want
    assert [align.align(a, b) for a, b in mine] == want
    assert align.align_pairs([""] * 3, [""] * 3) == [(0, "")] * 3 and align.align_pairs([], []) == []


def test_long_pairs_need_little_memory():
    rnd = random.Random(2)
    a = "".join(rnd.choice("acgt") for _ in range(6_000))
    b = "".join(rnd.choice("acgt") if rnd.random() < 0.1 else c for c in a if rnd.random() > 0.02)
    tracemalloc.start()
    distance, ops = align.align(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    i = j = bad = 0
    for o in ops:  # the ops spell both strings
        bad += o != "M"
        assert o not in "MS" or (a[i] == b[j]) == (o == "M")
        i, j = i + (o != "I"), j + (o != "D")
    assert (i, j, bad) == (len(a), len(b), distance)
    assert peak < 12_000_000  # the whole table has 144 MB
