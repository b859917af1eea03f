"""Partial-order alignment of many windows at once against a plain table, cell by cell; bands, groups, weights and edges."""

import random

import pytest
from pyspark.sql import functions as F

from seqweft.operators import partial_order
from seqweft.plans import queries


def plain(reads, match=2, mismatch=-4, gap=-4):
    """The same graph by dictionaries and whole tables."""
    reads = [r for r in reads if r]
    if not reads:
        return ""
    g = partial_order.Graph()
    g.thread([g.node(c) for c in reads[0]], 1)
    for read in reads[1:]:
        score = {(-1, j): gap * j for j in range(len(read) + 1)}
        for n in g.order():
            for j in range(len(read) + 1):
                best = max(score[p, j] + gap for p in g.before[n] or [-1])
                if j:
                    best = max(best, score[n, j - 1] + gap, *(score[p, j - 1] + (match if read[j - 1] == g.base[n] else mismatch) for p in g.before[n] or [-1]))
                score[n, j] = best
        end = max(g.ends(), key=lambda n: (score[n, len(read)], -n))
        g.thread(partial_order._trace(g, read, lambda n, j, score=score: score[n, j], end, (match, mismatch, gap)), 1)
    return g.heaviest()


def windows(seed, n=60):
    rnd = random.Random(seed)
    out = [[], [""], ["a"], ["", "b", ""], ["same"] * 5]
    for _ in range(n):
        letters = rnd.choice(["ab", "ACGT", "abcdefghijklmnop "])
        base, reads = [rnd.choice(letters) for _ in range(rnd.choice([3, 30, 60]))], []
        for _ in range(rnd.randint(1, 6)):
            b = list(base) if rnd.random() < 0.7 else [rnd.choice(letters) for _ in range(rnd.randint(0, 60))]
            for _ in range(rnd.randint(0, 6)):
                at = rnd.randrange(len(b) + 1)
                b[at : at + rnd.choice([0, 1, 1, 12])] = rnd.choice([[], [rnd.choice(letters)]])
            reads.append("".join(b))
        out.append(reads)
    return out


@pytest.mark.parametrize("cells", [12_000_000, 4_000])
def test_many_windows_equal_the_plain_table(monkeypatch, cells):
    monkeypatch.setattr(partial_order, "CELLS", cells)
    mine = windows(1)
    assert partial_order.poa_sequences(mine, band=None) == [plain(w) for w in mine]
    # a wide band holds the whole table, so it changes nothing
    assert partial_order.poa_sequences(mine, band=(500, 0.0)) == [plain(w) for w in mine]
    # and the narrow one gives each window what it gives alone
    assert partial_order.poa_sequences(mine) == [partial_order.poa_sequence(w) for w in mine]


def test_the_band_finds_what_the_whole_table_finds_in_alike_reads():
    rnd = random.Random(4)
    base = "".join(rnd.choice("ACGT") for _ in range(800))
    reads = ["".join(c for c in base if rnd.random() > 0.02) for _ in range(6)]
    assert partial_order.poa_sequence(reads) == partial_order.poa_sequence(reads, band=None)


def tables(score, width, seed=5):
    """Graphs of a few reads each, the next read, and both kinds of table of all of them at once."""
    jobs = []
    for w in windows(seed, 40):
        reads = [r for r in w if r]
        if len(reads) > 1:
            g = partial_order.Graph()
            g.thread([g.node(c) for c in reads[0]], 1)
            for r in reads[1:-1]:
                whole = partial_order._Rows([(g, partial_order._level(g), r)], score).whole()[0]
                g.thread(partial_order._trace(g, r, whole, max(g.ends(), key=lambda n, whole=whole, m=len(r): (whole(n, m), -n)), score), 1)
            jobs.append((g, reads[-1]))
    rows = partial_order._Rows([(g, x, r) for (g, r), x in zip(jobs, partial_order._levels([g for g, _ in jobs]), strict=True)], score)
    return jobs, rows, rows.whole(), rows.banded([width] * len(jobs))


@pytest.mark.parametrize("score", [(2, -4, -4), (1, -3, -2), (300, -900, -700)])
def test_levels_of_many_windows_are_filled_at_once(score):
    match, mismatch, gap = score
    jobs, rows, whole, banded = tables(score, 4)
    longest = [int(partial_order._level(g)[0].max()) + 1 for g, _ in jobs]
    assert len(rows.steps) == max(longest) < sum(len(g.base) for g, _ in jobs) / 10
    assert rows.kind.__name__ == ("int32" if match == 300 else "int16")
    for (g, read), at_column, in_band in zip(jobs, whole, banded, strict=True):
        alone = partial_order._banded(g, partial_order._level(g)[0], read, 4, score)
        score_at = {(-1, j): gap * j for j in range(len(read) + 1)}
        for n in g.order():
            for j in range(len(read) + 1):
                best = max(score_at[p, j] + gap for p in g.before[n] or [-1])
                if j:
                    best = max(best, score_at[n, j - 1] + gap, *(score_at[p, j - 1] + (match if read[j - 1] == g.base[n] else mismatch) for p in g.before[n] or [-1]))
                score_at[n, j] = best
                assert at_column(n, j) == best
                # in the band the same cells are reached, with the same scores
                reached = in_band(n, j) - gap * j > rows.unreached
                assert reached == (alone(n, j) > partial_order._NEVER // 2)
                assert not reached or in_band(n, j) == alone(n, j) <= best


@pytest.mark.parametrize("rows", [0, 1 << 30])
def test_bands_at_once_and_a_row_at_a_time(monkeypatch, rows):
    mine = windows(11)
    want = [partial_order.poa_sequence(w) for w in mine]
    monkeypatch.setattr(partial_order, "ROWS", rows)
    assert partial_order.poa_sequences(mine) == want
    monkeypatch.setattr(partial_order, "CELLS", 3_000)  # bands of many windows in parts
    assert partial_order.poa_sequences(mine) == want


def test_weights_are_repeated_reads():
    for w in windows(7, 25):
        times = [1 + len(r) % 3 for r in w]
        twice = [r for r, n in zip(w, times, strict=True) for _ in range(n)]
        if len(set(w)) == len(w) and len(w) == 2:
            assert partial_order.poa_sequences([w], weights=[times])[0] == partial_order.poa_sequence(twice)


def test_operator(spark):
    rows = [(k, i, r) for k, w in enumerate(windows(9, 20)) for i, r in enumerate(w)] + [(999, 0, None), (None, 0, "AC"), (None, 1, "AC")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "w int, o int, s string, n_reads string").repartition(3)
    want = {}
    for k, o, r in sorted(rows, key=str):
        want.setdefault(k, []).append((o, r or ""))
    want = {k: [r for _, r in sorted(v)] for k, v in want.items()}
    for work in (5_000, 1 << 40):
        got = partial_order.window_poa(df, ["w"], "o", "s", work=work)
        assert got.columns == ["w", "n_reads", "sequence"]
        assert {(r.w, r.n_reads, r.sequence) for r in got.collect()} == {(k, len(v), partial_order.poa_sequence(v)) for k, v in want.items()}
    two = partial_order.window_poa(df, ["w"], "o", "s", least=2, unknown_as="A")
    upper = {k: ["".join(c if c in "ACGT" else "A" for c in r) for r in v] for k, v in want.items()}
    assert {(r.w, r.sequence) for r in two.collect()} == {(k, partial_order.poa_sequence(v) if len(v) >= 2 else "") for k, v in upper.items()}
    assert partial_order.window_poa(df.where("false"), ["w"], "o", "s").count() == 0


def test_groups_of_deep_windows(spark):
    rnd = random.Random(3)
    base = "".join(rnd.choice("ACGT") for _ in range(120))
    reads = ["".join(rnd.choice("ACGT") if rnd.random() < 0.05 else c for c in base if rnd.random() > 0.03) for _ in range(90)]
    df = spark.createDataFrame([("deep", i, r) for i, r in enumerate(reads)] + [("flat", i, r) for i, r in enumerate(reads[:8])], "w string, o int, s string")
    got = {r.w: r for r in partial_order.window_poa(df, ["w"], "o", "s", depth=10).collect()}
    assert (got["deep"].sequence, got["deep"].n_reads) == (base, 90)
    assert got["flat"].sequence == partial_order.poa_sequence(reads[:8])


def test_query_rows(spark):
    sf = "/root/testdata/sf0.001"
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.upper("text").alias("s")).collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.s or ""))
    got = {r.conv_id: (r.n_reads, r.sequence) for r in queries.window_poa(spark, sf).collect()}
    assert got == {k: (len(v), partial_order.poa_sequence([s for _, s in sorted(v)])) for k, v in turns.items()}
