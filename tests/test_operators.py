"""Operators and readers against hand-made cases and brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweft.functions import align, decode
from seqweft.functions import sequence as sq
from seqweft.operators import metrics, ordered, partial_order, records, rules
from seqweft.sources import formats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_variants_at_the_slices_ends():
    assert align.spike_in("AC", 1, [(1, "ACG", "ATG")]) == "AT"
    assert align.spike_in("AC", 1, [(2, "CGT", "T")]) == "AT"  # ALT has fewer letters than are cut: it stays
    assert align.spike_in("CG", 2, [(1, "ACG", "ATG")]) == "TG"
    assert align.spike_in("ACGT", 1, [(2, "C", "")]) == "ACGT" and align.spike_in("ACGT", 1, [(2, "C", "")], True) == "AGT"


def test_udfs_take_nulls(spark):
    df = spark.createDataFrame([("AC", "AG", 1, 1.0), (None, "A", None, None)], "a string, b string, n int, s double")
    got = df.select(
        align.indel_distances("a", "b").alias("d"),
        align.spiked("a", "n", F.array(F.struct(F.lit(2).alias("pos"), F.lit("C").alias("ref"), F.lit("T").alias("alt")))).alias("v"),
        align.spiked("a", "n", F.lit(None).cast("array<struct<pos:int,ref:string,alt:string>>")).alias("w"),
        align.lifted(F.when(F.col("a").isNotNull(), sq.parse_cigar(F.lit("5M"))), F.lit(0), F.lit(1), F.lit(3)).alias("l"),
        decode.beam_udf(2, "A")(F.when(F.col("a").isNotNull(), F.array(F.lit(0.0), F.lit(1.0)))).alias("p"),
        decode.enter_extend_udf()(F.when(F.col("a").isNotNull(), F.array(*map(F.lit, np.eye(8)[1].tolist())))).alias("e"),
        decode.ctc_nll_udf(2)(F.when(F.col("a").isNotNull(), F.array(F.lit(0.0), F.lit(0.0))), F.array(F.lit(1))).alias("c"),
    ).collect()
    assert (got[0].d, got[0].v, got[0].w, got[0].l.qs, got[0].l.qe, got[0].p.text, got[0].e.text) == (2, "AT", "AC", 1, 3, "A", "C") and abs(got[0].c - np.log(2)) < 1e-9
    r = got[1]
    assert (r.d, r.v, r.w, r.l.qs, r.p.text, r.e.text, r.c) == (None,) * 7


def test_pruned_beam_keeps_the_blank():
    lp = np.log([[0.3, 0.7], [0.3, 0.7]])
    assert decode.prefix_beam(lp, 10, prune=0.5)[0] == (1,) and abs(decode.prefix_beam(lp, 10, prune=0.5)[1] - np.log(0.91)) < 1e-9
    assert decode.prefix_beam(lp, 10, prune=0) == decode.prefix_beam(lp, 10)
    assert decode.prefix_beam(lp, 10, stay=-np.inf)[1] == pytest.approx(np.log(0.42))


def test_enter_extend_is_the_best_path(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4, 8))
    allowed = lambda p: p[0] < 4 and all(b < 4 or b - 4 == a % 4 for a, b in itertools.pairwise(p))
    best = max(filter(allowed, itertools.product(range(8), repeat=4)), key=lambda p: sum(x[i, s] for i, s in enumerate(p)))
    got = one(spark, decode.enter_extend_udf()(F.array(*map(F.lit, x.ravel().tolist()))))
    assert got.text == decode.enter_extend_runs(list(best))[0] and abs(got.score - sum(x[i, s] for i, s in enumerate(best))) < 1e-9
    blank = one(spark, decode.blank_viterbi_udf(3, "AC")(F.array(*map(F.lit, np.eye(3)[[1, 1, 0, 1, 2, 2]].ravel().tolist()))))
    assert (blank.text, blank.frames) == ("AAC", [2, 1, 2])


def test_likelihood_sums_all_alignments(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4, 3))
    lp = decode.log_softmax(x)
    collapse = lambda p: [k for k, _ in itertools.groupby(p) if k]
    total = sum(np.exp(sum(lp[i, s] for i, s in enumerate(p))) for p in itertools.product(range(3), repeat=4) if collapse(p) == [1, 2])
    got = one(spark, decode.ctc_nll_udf(3)(F.array(*map(F.lit, x.ravel().tolist())), F.array(F.lit(1), F.lit(2))))
    assert abs(got + np.log(total)) < 1e-9


def test_crf_likelihood_sums_all_paths(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4, 8))
    allowed = [p for p in itertools.product(range(8), repeat=4) if p[0] < 4 and all(b < 4 or b - 4 == a % 4 for a, b in itertools.pairwise(p))]
    weight = lambda p: np.exp(sum(x[i, s] for i, s in enumerate(p)))
    for labels in ([2], [1, 1], [0, 3, 0], [1, 2, 3, 0]):
        own = sum(weight(p) for p in allowed if [s for s in p if s < 4] == labels)
        got = one(spark, decode.crf_nll_udf()(F.array(*map(F.lit, x.ravel().tolist())), F.array(*map(F.lit, labels))))
        assert abs(got - np.log(sum(map(weight, allowed)) / own)) < 1e-9
    assert decode.crf_nll(x, [0] * 5) == decode.crf_nll(x, []) == float("inf")


def test_models_are_loaded_once_for_each_task(spark):
    def load():
        return lambda rows: [[sum(r)] for r in rows]

    assert [r.y for r in spark.createDataFrame([([1.0, 2.0],), ([3.0],)], "x array<double>").select(decode.predict_udf(load)("x").alias("y")).collect()] == [[3.0], [3.0]]


def test_runs_made_whole():
    r = decode.fitted_runs([1, 2, 9], [3], [2, 2, 2, 2])
    assert (r["collapsed"], r["expanded"], r["char_runs"], r["frame_runs"]) == ("ACN", "AAACN", [3, 1, 1], [2, 2, 2])
    assert decode.fitted_runs([], tokens=[1, 1, 4])["collapsed"] == "AT"


def test_indel_distance_brute():
    def longest(a, b):
        return max((n for n in range(len(a) + 1) for c in itertools.combinations(a, n) if iter_in(c, b)), default=0)

    def iter_in(c, b):
        it = iter(b)
        return all(x in it for x in c)

    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("ACg"), rng.integers(0, 7))) for _ in range(2))
        assert align.indel_distance(a, b) == len(a) + len(b) - 2 * longest(a, b)


def test_homopolymer_accuracy_by_hand(spark):
    df = spark.createDataFrame([("ACGGGTA", "ACGGGGTA"), ("AACC", "AACT"), ("ACGT", "ACGT")], "ref string, hyp string")
    r = metrics.homopolymer_accuracy(df, "ref", "hyp", 2).first()
    # GGG: three matches and, by the alignment, an insertion behind the place before it; AACC: three of four; the last has no runs
    assert r.n == 2 and r.micro_reference == 6 / 7
    c = metrics.homopolymer_accuracy(df, "ref", "hyp", None).first()
    assert c.n == 3


def test_band_finds_what_all_columns_find():
    rng = np.random.default_rng(8)
    for trial in range(12):
        base = rng.choice(list("ACGT"), 120)
        reads = []
        for _ in range(5):
            r = [c for c in base if rng.random() > 0.04]
            for _ in range(4):
                r[int(rng.integers(0, len(r)))] = str(rng.choice(list("ACGT")))
            reads.append("".join(r))
        assert partial_order.poa_sequence(reads) == partial_order.poa_sequence(reads, band=None), trial
    assert partial_order.poa_sequence(["A" * 50, "C" * 200]) == partial_order.poa_sequence(["A" * 50, "C" * 200], band=None)


def test_slices_give_the_same(spark):
    rng = np.random.default_rng(6)
    rows = [(("a", "b", None)[i % 7 % 3], int(rng.integers(0, 60)), i, int(rng.integers(1, 9)), int(rng.integers(0, 3))) for i in range(600)]
    df = spark.createDataFrame(rows, "p string, t int, i int, n int, x int").withColumn("e", F.col("t") + F.col("n"))
    for f in (
        lambda **k: ordered.offset_plan(df, "p", "n", ["t", "i"], **k),
        lambda **k: ordered.run_length(df, "p", ["t", "i"], "x", **k),
        lambda **k: ordered.contiguity(df, "p", "t", "e", **k),
        lambda **k: ordered.numbered(df, "p", ["t", "i"], "k", **k).select("p", "i", F.col("k").cast("long")),
    ):
        assert sorted(map(str, f(slice_rows=40).collect())) == sorted(map(str, f().collect()))


def test_readers_work_by_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        fq = [(f"r{i} x", "ACGT" * (i % 9 + 1), ("@", "+", "I")[i % 3] * 4 * (i % 9 + 1)) for i in range(60)]
        (tmp_path / "a.fastq").write_text("".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in fq))
        df = formats.read_fastq(spark, str(tmp_path / "a.fastq"))
        assert spark.read.text(str(tmp_path / "a.fastq")).rdd.getNumPartitions() > 5
        assert [(r.header, r.seq, r.qual) for r in df.orderBy("pos").collect()] == fq
        assert formats.fastq_lengths(df).agg(F.sum("length")).first()[0] == sum(len(s) for _, s, _ in fq)
        fa = [(f"c{i}", "ACGTN" * i) for i in range(40)]
        (tmp_path / "a.fa").write_text("\r\n" + "".join(f">{n} more\r\n{s[:30]}\r\n\r\n{s[30:]}\n" for n, s in fa))
        got = formats.read_fasta(spark, str(tmp_path / "a.fa"))
        assert [(r.name, r.seq) for r in got.orderBy("block", "row").collect()] == fa
        assert formats.fasta_lengths(got).count() == 39
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "bad.fastq").write_text("@a\nAC\n+\nII\n@b\nAC\nx\nII\n@c\nA\n+\nI\n")
    with pytest.raises(Exception, match="bad record"):
        formats.read_fastq(spark, str(tmp_path / "bad.fastq")).collect()
    assert [r.read_id for r in formats.read_fastq(spark, str(tmp_path / "bad.fastq"), strict=False).collect()] == ["a"]
    (tmp_path / "bad.fa").write_text("x\n>a\nAC\n")
    with pytest.raises(Exception, match="before the first record"):
        formats.read_fasta(spark, str(tmp_path / "bad.fa")).collect()


def test_files_and_regions(spark, tmp_path):
    for s in ("s2", "s1", "s1/deep"):
        (tmp_path / s).mkdir(parents=True)
        (tmp_path / s / "index.tsv").write_text("x y\n1  2\n\n")
    (tmp_path / "one.fa").write_text(">chr1\nacgtacgt\n")
    assert [r.segment.rsplit("/", 1)[1] for r in formats.segments(spark, str(tmp_path), "index.tsv").collect()] == ["s1", "deep", "s2"]
    assert formats.resolve(spark, str(tmp_path), ("*.none", "*.fa")).endswith("one.fa") and formats.resolve(spark, str(tmp_path), ("*.none",)) is None
    with pytest.raises(ValueError):
        formats.resolve(spark, str(tmp_path), ("s*",))
    assert [tuple(r) for r in formats.read_columns(spark, str(tmp_path / "s1/index.tsv"), ["a", "b"]).collect()] == [("x", "y"), ("1", "2")]
    with pytest.raises(Exception, match="not 3 columns"):
        formats.read_columns(spark, str(tmp_path / "s1/index.tsv"), ["a", "b", "c"]).collect()
    regions = spark.createDataFrame([("chr1", 2, 4), ("chr1", 7, 99), ("chr2", 1, 2)], "chrom string, start int, end int")
    got = formats.slices(regions, formats.read_fasta(spark, str(tmp_path / "one.fa")))
    assert sorted((r.chrom, r.start, r.seq) for r in got.collect()) == [("chr1", 2, "CGT"), ("chr1", 7, "GT"), ("chr2", 1, None)]


def test_entries(spark):
    df = spark.createDataFrame([(1, [1, 0, 1], "AC", 3), (2, [0], "", 3), (3, [1], "ACG", 3), (4, None, "A", 3)], "i int, moves array<int>, seq string, flag int")
    r = records.entry_rules("moves", "seq")
    assert [x.i for x in records.pruned(df, r).collect()] == [1]
    with pytest.raises(Exception, match="no_moves|more_letters"):
        records.checked(df, r).collect()
    off = records.with_features(df.where("i = 1"), "moves", "flag", False, False).first()
    assert off.moves == [0, 0, 0] and off.flag == 0
    cut = spark.createDataFrame([(1, 2, 5, [1] * 6, 0, 3, [1.0] * 3)], "i int, a int, n int, m array<int>, b int, k int, s array<double>")
    assert [x.code for x in rules.issues(cut, rules.cut_rules("a", "n", "m", "b", "k", "s"), "i").collect()] == ["mv_slice_len"]
    assert one(spark, sq.from_nibbles(F.array(*map(F.lit, (1, 2, 4, 8, 15))))) == "ACGTN"
    assert one(spark, sq.reference_row_of(F.lit("REFERENCE_chr1_1_2_hap2"))) == "hap2" and one(spark, sq.reference_row_of(F.lit("read_hap2"))) is None


def test_moves_of_sam(spark, tmp_path):
    rec = "{}\t{}\tchr1\t101\t20\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:0\tmv:B:c,{}\n"
    (tmp_path / "a.sam").write_text("@HD\n" + rec.format("q", 0, "6,1,0,1") + rec.format("r", 0, "5,1") + rec.format("q", 2048, "6,0,1,1") + "x\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    assert sorted((r.read_id, r.stride, r.moves) for r in formats.read_moves(spark, str(tmp_path / "a.sam")).collect()) == [("q", 6, [0, 1, 1]), ("r", 5, [1])]


def test_dataset_is_written_in_order(spark, tmp_path):
    index = spark.createDataFrame([("chr2", "b", "r2", 6, 6, 1, 1), ("chr1", "a", "r1", 0, 6, 0, 1)], "chr string, region string, read_id string, sig_offset long, sig_len long, mv_offset long, mv_len long")
    reads = index.select("chr", "region", "read_id", F.lit("AC").alias("seq"), F.lit("II").alias("qual"))
    refs = spark.createDataFrame([("chr1", "a", h, "ACGT") for h in ("other", "hap2", "hap1")], "chr string, region string, hap string, seq string")
    formats.write_dataset(index, reads, refs, str(tmp_path / "set"))
    assert [r.name for r in formats.read_fasta(spark, str(tmp_path / "set/refs.fasta/*.txt")).orderBy("path", "block", "row").collect()] == ["a_hap1", "a_hap2", "a_other"]
    assert [r.read_id for r in formats.read_fastq(spark, str(tmp_path / "set/reads.fastq/*.txt")).orderBy("path", "pos").collect()] == ["r1", "r2"]
    blocks = formats.read_tsv(spark, str(tmp_path / "set/region_blocks.tsv")).collect()
    assert sorted((r.region, r.sig_off, r.sig_len, r["count"]) for r in blocks) == [("a", "0", "6", "1"), ("b", "6", "6", "1")]
    from seqweft.operators import assembly

    nodes = spark.createDataFrame([("a", "1", "CG"), ("a", "2", "TT"), ("b", "3", "AC")], "region string, node string, seq string")
    assert sorted(tuple(r) for r in assembly.node_places(nodes, refs).collect()) == [("a", "1", h, 2) for h in ("hap1", "hap2", "other")]
