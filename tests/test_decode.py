"""Decoders and likelihoods of many rows at once against the same row by row; queries without SQL against their functions."""

import collections
import itertools

import numpy as np
import pytest

from seqweft.functions import align, decode
from seqweft.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("together", [256, 3])
def test_many_rows_are_each_row(monkeypatch, together):
    monkeypatch.setattr(decode, "TOGETHER", together)
    rng = np.random.default_rng(together)
    rows = [rng.normal(size=(rng.integers(1, 12), 8)) for _ in range(40)]
    labels = [rng.integers(0, 4, rng.integers(0, 6)).tolist() for _ in rows]
    assert np.allclose(decode.crf_nll_many(rows, labels), [decode.crf_nll(x, y) for x, y in zip(rows, labels, strict=True)])
    lp = [decode.log_softmax(x) for x in rows]
    own = [[v + 1 for v in y] for y in labels]
    assert np.allclose(decode.ctc_nll_many(lp, own), [decode.ctc_nll(x, y) for x, y in zip(lp, own, strict=True)])
    first = np.array([0.0] * 4 + [-np.inf] * 4)
    for transition, begin in ((decode.ENTER_EXTEND, first), (np.zeros((8, 8)), None)):
        many = decode.viterbi_many(rows, transition, begin)
        assert [p for p, _ in many] == [decode.viterbi(x, transition, begin)[0] for x in rows]
        assert np.allclose([s for _, s in many], [decode.viterbi(x, transition, begin)[1] for x in rows])
    assert decode.ctc_nll_many([], []) == [] == decode.viterbi_many([], decode.ENTER_EXTEND) == decode.crf_nll_many([], [])


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(row[j - 1], before[j])
    return row[-1]


def test_indel_distance_of_pairs():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abC"), rng.integers(0, 15))) for _ in range(2))
        assert align.indel_distance(a, b) == len(a) + len(b) - 2 * longest_common(a.lower(), b.lower())


def test_alignment_metrics_rows(spark):
    pairs = [(r.ref, r.hyp) for r in queries.pairs(spark, SF).select("ref", "hyp").collect()]
    found = [align.align(a, b) for a, b in pairs]
    got = queries.alignment_metrics(spark, SF).first()
    assert got.n == len(pairs)
    assert np.isclose(got.macro_aligned, np.mean([o.count("M") / len(o) for _, o in found]))
    assert np.isclose(got.micro_reference, sum(o.count("M") for _, o in found) / sum(len(a) for a, _ in pairs))
    assert np.isclose(got.mean_distance, np.mean([d for d, _ in found]))


def test_prefix_beam_rows(spark):
    """All labellings of 16 frames are too many; each frame's best ones summed over all paths of the first four frames are not."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").limit(5).collect()
    got = {r.vec_id: r.text for r in queries.prefix_beam(spark, SF).collect()}
    for r in rows:
        lp = decode.log_softmax(np.asarray(r.embedding, float).reshape(-1, 4))
        best, _ = decode.prefix_beam(lp, 20)
        assert got[r.vec_id] == "".join("ACG"[c - 1] for c in best)
        sums: dict = collections.defaultdict(float)
        for path in itertools.product(range(4), repeat=4):
            text = tuple(c for k, c in enumerate(path) if c and (k == 0 or path[k - 1] != c))
            sums[text] += float(np.exp(sum(lp[t, c] for t, c in enumerate(path))))
        top = max(sums, key=sums.get)
        found, p = decode.prefix_beam(lp[:4], 300)
        assert tuple(found) == top and np.isclose(p, np.log(sums[top]))


def test_base_codes(spark):
    from pyspark.sql import functions as F

    from seqweft.functions import sequence as sq

    df = spark.createDataFrame([("acGTNé日x",), ("",), (None,), ("A",)], "s string")
    for unknown in (4, 9, -1, 12):
        got = [r.c for r in df.select(sq.base_codes(F.col("s"), unknown).alias("c")).collect()]
        assert got == [[0, 1, 2, 3, *[unknown] * 4], [], None, [0]]
    codes = spark.createDataFrame([([0, 1, 2, 3, 4, -1, 12, None, 30, 0],), ([],), (None,), ([13],)], "c array<int>")
    assert [r.s for r in codes.select(sq.from_base_codes(F.col("c")).alias("s")).collect()] == ["ACGTNNNNNA", "", None, "N"]
