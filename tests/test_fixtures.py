"""Hand-checked fixtures and brute-force properties of the library's functions."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqweft.functions import align as al
from seqweft.functions import decode as de
from seqweft.functions import sequence as sq
from seqweft.operators import partial_order, keyed, ordered, tiling
from seqweft.sources import formats

CIGAR = [("S", 3), ("M", 5), ("D", 2), ("M", 4), ("I", 1), ("M", 3), ("S", 2)]


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "want"), [(2000, [(0, 1, 1000), (1, 951, 1950), (2, 1901, 2000)]), (0, []), (1, [(0, 1, 1)]), (1000, [(0, 1, 1000)]), (1001, [(0, 1, 1000), (1, 951, 1001)])])
def test_tiles(spark, n, want):
    df = spark.createDataFrame([("c", n)], "chrom string, len long")
    assert sorted((r.idx, r.ws, r.we) for r in tiling.tile_windows(df).collect()) == want


def test_tiles_reject_overlap(spark):
    with pytest.raises(ValueError):
        tiling.tile_windows(spark.createDataFrame([("c", 1)], "chrom string, len long"), window=10, overlap=10)


def test_lift():
    assert al.lift(CIGAR, 100, 102, 110) == (5, 11)
    assert al.lift(CIGAR, 100, 102, 120) == (5, 18)
    assert al.lift(CIGAR, 100, 102, 120, stop_at_clip=True) == (5, 16)


def test_flip(spark):
    a, b = sq.flip_span(F.lit(5), F.lit(11), F.lit(18), F.lit(True))
    assert one(spark, F.struct(a, b)) == (7, 13)


def test_spike_in():
    v = [(12, "C", "T"), (14, "T", "TGG"), (16, "CG", "C")]
    assert al.spike_in("ACGTACGTAC", 11, v) == "ATGTGGACTAC"
    assert al.spike_in("ACGTACGTAC", 11, sorted([*v, (12, "G", "A"), (13, "G", "*")])) == "ATGTGGACTAC"
    assert al.spike_in("ACGT", 11, [(10, "TA", "TG")]) == "GCGT"


def test_stitch(spark):
    rows = [("c", i, s, i * 10 + 1, i * 10 + 10) for i, s in enumerate(["AAACCC", "CCCGGG", "", "TTTT"])]
    df = spark.createDataFrame(rows, "c string, i int, s string, a int, b int")
    got = sorted((r.first_idx, r.last_idx, r.sequence) for r in ordered.stitch(df, "c", "i", "s", 3, "a", "b").collect())
    assert got == [(0, 1, "AAACCCGGG"), (3, 3, "TTTT")]


@pytest.mark.parametrize(("r", "h", "want"), [("ACGT", "AGT", (1, "MDMM")), ("AAAC", "AAC", (1, "DMMM")), ("", "AC", (2, "II")), ("AC", "GT", (2, "SS")), ("ACGGGTA", "ACGGGGTA", (1, "MMIMMMMM"))])
def test_align(r, h, want):
    assert al.align(r, h) == want


@settings(max_examples=60, deadline=None)
@given(st.text("ACG", max_size=9), st.text("ACG", max_size=9))
def test_align_is_edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(prev + (x != y), d[j] + 1, d[j - 1] + 1)
    dist, ops = al.align(a, b)
    assert dist == d[-1] and ops.count("M") + ops.count("S") + ops.count("D") == len(a)


def test_homopolymers(spark):
    ops = al.align("ACGGGTA", "ACGGGGTA")[1]
    mask = [2 <= i < 5 for i in range(7)]
    assert al.masked_stats(ops, mask) == (3, 0, 3)
    r = one(spark, sq.central_run(F.lit("ACGGGTA")))
    assert (r.start, r.end) == (2, 5)
    left, right = sq.flanks(F.lit("ACGGGTA"), F.lit(2), F.lit(5))
    assert one(spark, F.struct(left, right)) == ("NAC", "TAN")
    assert one(spark, sq.homopolymer_weight(F.lit(7))) == 1.5
    assert one(spark, sq.run_mask(F.array(*map(F.lit, [1, 1, 2, 2, 2, 3])), 3)) == [False, False, True, True, True, False]


def test_ctc_arrays(spark):
    assert one(spark, sq.greedy_ctc(F.array(*map(F.lit, [0, 1, 1, 0, 1, 2, 2, 0, 3])))) == "AACG"
    for s, n in (("AACG", 5), ("", 0), ("A", 1)):
        assert one(spark, sq.ctc_length(sq.letters(F.lit(s)))) == n


def test_move_slice(spark):
    m = F.array(*map(F.lit, [1, 0, 1, 0, 0, 1, 1, 0]))
    assert one(spark, sq.move_slice(m, F.lit(1), F.lit(3), F.lit(6))) == (2, 4, 24)
    assert one(spark, sq.move_slice(m, F.lit(3), F.lit(3), F.lit(6))) is None
    assert one(spark, sq.expand_bases(F.lit("ACG"), F.array(*(F.lit(x).cast("bigint") for x in (1, 0, 2))))) == ["A", "", "G"]


def test_contiguity(spark):
    df = spark.createDataFrame([("s", a, b, 16) for a, b in [(0, 4), (4, 6), (5, 9), (12, 14)]], "s string, a int, b int, n int")
    r = ordered.contiguity(df, "s", "a", "b", "n").first()
    assert (r.n_gaps, r.gap_total, r.n_overlap, r.overlap_total, r.unused_tail) == (1, 3, 1, 1, 2)


def test_genotype(spark):
    a, b = sq.genotype(F.lit("DP:GT"), F.lit("30:0|2"), F.lit("A,T"))
    assert one(spark, F.struct(a, b)) == ("", "T")


def test_splits():
    assert ordered.split_counts(10) == (9, 1, 0)
    assert ordered.split_counts(10, 0.8, 0.1, 0.1) == (8, 1, 1)
    assert ordered.split_counts(7) == (6, 1, 0)
    order = [f"r{i}" for i in range(6)]
    random.Random(42).shuffle(order)
    assert order == ["r3", "r1", "r2", "r4", "r0", "r5"]
    assert set(ordered.shuffled_split(["a", "b", "c"]).values()) <= {"train", "val", "test"}


@pytest.mark.parametrize(("left", "right", "says"), [("abc", "ab", "shorter"), ("abc", "abcd", "longer"), ("abc", "axc", "differ")])
def test_zip_join_errors(spark, left, right, says):
    f = lambda s, n: spark.createDataFrame([("p", i, c) for i, c in enumerate(s)], f"p string, {n}_i int, {n} string")
    with pytest.raises(PySparkException, match=says):
        keyed.zip_join(f(left, "l"), f(right, "r"), "p", ["l_i"], ["r_i"], "l", "r").collect()


def test_occurrences(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "i int, id string")
    b = spark.createDataFrame([(0, "x", "AA"), (1, "x", "CC"), (2, "y", "GG")], "j int, id string, s string")
    assert [r.s for r in keyed.occurrence_join(a, b, "id", ["i"], ["j"]).orderBy("i").collect()] == ["AA", "GG", "CC"]


def collapse(path):
    return tuple(x for x, _ in itertools.groupby(path) if x)


def test_beam_and_likelihood_are_exhaustive_sums():
    rng = np.random.default_rng(1)
    lp = de.log_softmax(rng.normal(size=(5, 3)))
    total: dict = {}
    for path in itertools.product(range(3), repeat=5):
        k = collapse(path)
        total[k] = np.logaddexp(total.get(k, -np.inf), sum(lp[t, c] for t, c in enumerate(path)))
    best = max(total, key=total.get)
    text, p = de.prefix_beam(lp, 100)
    assert text == best and abs(p - total[best]) < 1e-9
    for k, v in total.items():
        assert abs(de.ctc_nll(lp, list(k)) + v) < 1e-9


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    e, t = rng.normal(size=(5, 4)), rng.normal(size=(4, 4))
    best = max(itertools.product(range(4), repeat=5), key=lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False)))
    assert tuple(de.viterbi(e, t)[0]) == best
    assert de.enter_extend_runs([0, 4, 4, 0, 1, 5]) == ("AAC", [3, 1, 2])


def test_partial_order():
    assert partial_order.poa_sequence([]) == ""
    assert partial_order.poa_sequence(["ACGTACGT"] * 3) == "ACGTACGT"
    assert partial_order.poa_sequence(["ACGTACGT", "ACGAACGT", "ACGTACGT"]) == "ACGTACGT"
    assert partial_order.poa_sequence(["ACGTACGT", "ACGTCGT", "ACGTACGT"]) == "ACGTACGT"


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([("r1 x", "ACGT" * 40, "I" * 160), ("r2", "AC", "II")], "h string, s string, q string")
    formats.write_lines(formats.fasta_lines(df.coalesce(1), "h", "s"), str(tmp_path / "fa"))
    assert sorted((r.name, r.seq) for r in formats.read_fasta(spark, str(tmp_path / "fa/*.txt")).collect()) == [("r1", "ACGT" * 40), ("r2", "AC")]
    formats.write_lines(formats.fastq_lines(df.coalesce(1), "h", "s", "q"), str(tmp_path / "fq"))
    assert sorted((r.read_id, r.qual) for r in formats.read_fastq(spark, str(tmp_path / "fq/*.txt")).collect()) == [("r1", "I" * 160), ("r2", "II")]
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\nchr1\t12\t.\tC\tT,*\t.\t.\t.\tDP:GT\t3:0|1\n")
    assert formats.read_vcf(spark, str(tmp_path / "v.vcf")).collect() == [("chr1", 12, "C", "T,*", "DP:GT", "3:0|1")]
    (tmp_path / "a.sam").write_text("@HD\nq\t16\tchr1\t101\t20\t3S5M\t*\t0\t0\tACGTACGT\tIIIIIIII\n")
    r = formats.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert r.pos == 100 and [(c.op, c.len) for c in r.cigar] == [("S", 3), ("M", 5)]


def test_ordered_emission(spark, tmp_path):
    from seqweft.streaming import windows

    src = tmp_path / "in"
    spark.createDataFrame([("c", 2, "z"), ("c", 0, "x"), ("c", 1, "y"), ("c", 4, "late")], "p string, i long, v string").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("p string, i long, v string").parquet(str(src))
    q = windows.in_order(stream, "p", "i", "v").writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.i, r.v) for r in spark.table("ordered").orderBy("i").collect()] == [(0, "x"), (1, "y"), (2, "z")]


def test_signals(spark):
    from seqweft.functions import signal as sg

    arr = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, sg.robust_normalised(arr(1.0, 2.0, 4.0, 8.0))) == [-1, 0, 2, 6]
    assert one(spark, sg.weighted_mean(arr(1.0, 3.0), arr(1.0, 3.0))) == 2.5
    assert one(spark, sg.padding_mask(F.lit(1), F.lit(3))) == [False, True, True]
    assert one(spark, sg.common_padding(F.array(arr(False, True), arr(True, True)))) == [False, True]
    assert abs(one(spark, sg.duration_loss(arr(0.0), arr(1.0))) - np.log(2)) < 1e-12
    r = one(spark, sg.enter_rates(arr(0, 4, 0, 1)))
    assert (r.enter, r.extend, r.enter_rate, r.reentered) == (3, 1, 0.75, 1)
    x = arr(*(float(i) for i in range(30)))
    masked = one(spark, sg.time_masked(x, F.lit(3)))
    assert masked == one(spark, sg.time_masked(x, F.lit(3))) and all(v in (0, i) for i, v in enumerate(masked))
    assert np.allclose(one(spark, sg.time_stretched(x, F.lit(2.0))), range(30), atol=1.0)
    assert np.allclose(one(spark, sg.resampled(x, F.lit(59))), np.arange(59) / 2)
    assert one(spark, sg.noisy(x, F.lit(1), 0.5)) == one(spark, sg.noisy(x, F.lit(1), 0.5))
    assert len(one(spark, sg.fourier_features(F.lit(0.5), [1.0, 2.0]))) == 6


def test_assembly(spark):
    from seqweft.operators import assembly

    rows = [("c", 0, "AAACCC"), ("c", 1, "CCCGGG"), ("c", 2, "TTTAAA"), ("c", 3, ""), ("c", 4, "GG")]
    df = spark.createDataFrame(rows, "c string, i int, s string")
    got = sorted((r.first_idx, r.last_idx, r.sequence, r.bad_breaks) for r in assembly.stitch_checked(df, "c", "i", "s", 3).collect())
    assert got == [(0, 1, "AAACCCGGG", 1), (2, 2, "TTTAAA", 1), (4, 4, "GG", 1)]
    g = spark.createDataFrame([("H\tx",), ("S\t1\tACG",), ("S\t2\tTTT",), ("L\t1\t+\t2\t-\t0M",)], "value string")
    assert assembly.reference_coverage(assembly.gfa_nodes(g), "GACGA").first() == (2, 1, 0.6)
    assert assembly.gfa_edges(g).first() == ("1", "+", "2", "-")


def test_registry():
    from seqweft.registry import Registry

    r = Registry("thing")
    r.register("a")(dict)
    with pytest.raises(KeyError):
        r.register("a")
    with pytest.raises(KeyError, match="there are a"):
        r.create("b")
    assert r.create("a", x=1) == {"x": 1}


def test_sealed_windows(spark, tmp_path):
    from seqweft.streaming import windows

    src = tmp_path / "in"
    spark.sql("select timestamp_seconds(id * 100) as ts, 'c' as k from range(60)").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(src))
    q = windows.sealed_counts(stream, "ts", "k").writeStream.format("memory").queryName("sealed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("sealed").orderBy("start").collect()
    assert got and all(9 <= r.n <= 10 for r in got[1:])
