"""Expressions over base strings, alignments and arrays; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flag bits of records that are not primary alignments: unmapped, secondary, supplementary (fixed values of SAM).
NOT_PRIMARY = 0x904


def let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def is_primary(flag: Column) -> Column:
    return flag.bitwiseAND(NOT_PRIMARY) == 0


def long_enough(length: Column, span: Column, ratio: float = 0.9) -> Column:
    return length >= F.greatest(F.ceil(span * F.lit(float(ratio))), F.lit(1))


def long_enough_region(length: Column, start: Column, end: Column, ratio: float = 0.9) -> Column:
    """long_enough() for regions, whose span is end - start without the last place."""
    return long_enough(length, end - start, ratio)


def only_acgt(seq: Column) -> Column:
    return ~seq.rlike("[^ACGT]")


def sanitise(seq: Column, policy: str = "skip") -> Column:
    """Upper case with other letters dropped, or an error; an empty result is an error."""
    up = F.upper(seq)
    clean = F.regexp_replace(up, "[^ACGT]", "")
    if policy == "error":
        clean = F.when(up.rlike("[^ACGT]"), F.raise_error(F.concat(F.lit("bases other than ACGT: "), up))).otherwise(up)
    return F.when(F.length(clean) == 0, F.raise_error(F.lit("no bases are left"))).otherwise(clean)


def span_of(cigar: Column, ops: str) -> Column:
    """Sum of the lengths of some ops of array<struct<op, len>>."""
    return F.aggregate(F.filter(cigar, lambda x: F.instr(F.lit(ops), x["op"]) > 0), F.lit(0).cast("long"), lambda a, x: a + x["len"])


def reference_span(cigar: Column) -> Column:
    return span_of(cigar, "M=XDN")


def query_span(cigar: Column) -> Column:
    return span_of(cigar, "MIS=X")


def parse_cigar(text: Column) -> Column:
    ops = F.regexp_extract_all(text, F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(ops, lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.left(x, F.length(x) - 1).cast("int").alias("len")))


def cigar_text(cigar: Column) -> Column:
    return F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def flip_span(start: Column, end: Column, length: Column, reverse: Column) -> tuple[Column, Column]:
    """[start, end) in the read's own direction, inside [0, length]."""
    clamp = lambda c: F.greatest(F.lit(0), F.least(c, length))
    a = F.when(reverse, F.greatest(F.lit(0), length - end)).otherwise(clamp(start))
    b = F.when(reverse, F.greatest(a, length - start)).otherwise(F.greatest(clamp(start), clamp(end)))
    return a, b


def cut(seq: Column, start: Column, end: Column) -> Column:
    a = F.greatest(F.lit(0), F.least(start, F.length(seq)))
    return F.substring(seq, a + 1, F.greatest(F.lit(0), F.least(end, F.length(seq)) - a))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def phred_text(quals: Column, length: Column) -> Column:
    """Phred + 33 as text; without qualities, I throughout."""
    missing = quals.isNull() | F.exists(quals, lambda q: q == 255)
    return F.when(missing, F.repeat(F.lit("I"), length)).otherwise(F.array_join(F.transform(quals, lambda q: F.char(q + 33)), ""))


def mean_quality(quals: Column, most: int = 60) -> Column:
    used = F.filter(quals, lambda q: q <= most)
    return F.when(F.size(used) > 0, F.aggregate(used, F.lit(0.0), lambda a, q: a + q) / F.size(used)).otherwise(0.0)


def letters(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda x: x != "")


def ctc_length(items: Column) -> Column:
    """Frames that a label sequence needs: its length and one more for each equal neighbour."""
    return F.size(items) + F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1))), lambda i: F.coalesce(F.get(items, i) == F.get(items, i - 1), F.lit(False))))


def longest_run(items: Column) -> Column:
    begin = F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"), F.lit(None).cast("string").alias("last"))

    def step(a, x):
        now = F.when(a["last"].eqNullSafe(x.cast("string")), a["now"] + 1).otherwise(1)
        return F.struct(F.greatest(a["best"], now).alias("best"), now.alias("now"), x.cast("string").alias("last"))

    return F.aggregate(items, begin, step, lambda a: a["best"])


def homopolymer_weight(run: Column, least: int = 4, cap: int = 10, boost: float = 2.0) -> Column:
    if cap <= least:
        return F.when(run <= least, 1.0).otherwise(float(boost))
    return F.when(run <= least, 1.0).otherwise(1 + F.lit(float(boost) - 1) * (F.least(run, F.lit(cap)) - least) / F.lit(float(cap - least)))


def central_run(seq: Column) -> Column:
    """struct(start, end) of the run of equal letters around the centre (length - 1) // 2; null for an empty string."""
    n = F.length(seq)
    mid = F.floor((n - 1) / 2).cast("int")
    base = F.substring(seq, mid + 1, F.lit(1))
    left = F.reverse(F.substring(seq, F.lit(1), mid + 1))
    right = F.substring(seq, mid + 1, n)
    same = lambda s: F.length(s) - F.length(F.ltrim(s, base))
    return F.when(n > 0, F.struct((mid + 1 - same(left)).alias("start"), (mid + same(right)).alias("end")))


def run_mask(items: Column, least: int) -> Column:
    """Whether each item is in a run of at least `least`."""
    idx = F.sequence(F.lit(0), F.size(items) - 1)
    if least <= 1:
        return F.transform(items, lambda x: F.lit(True))
    starts = F.filter(idx, lambda i: (i == 0) | (F.get(items, i) != F.get(items, i - 1)))
    return F.when(F.size(items) == 0, F.array().cast("array<boolean>")).otherwise(
        let(starts, lambda s: F.flatten(F.transform(s, lambda a, k: let(F.coalesce(F.get(s, k + 1), F.size(items)) - a, lambda n: F.array_repeat(n >= least, n)))))
    )


def flanks(seq: Column, start: Column, end: Column, k: int = 3) -> tuple[Column, Column]:
    """k letters on each side of [start, end), filled up with N."""
    a = F.greatest(start - k, F.lit(0))
    return F.lpad(F.substring(seq, a + 1, start - a), k, "N"), F.rpad(F.substring(seq, end + 1, F.lit(k)), k, "N")


def expand_bases(seq: Column, moves: Column) -> Column:
    """Array over moves: the base that a positive move reads, else ''; an error unless the moves sum to the length."""
    begin = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<string>").alias("out"))
    step = lambda a, m: F.struct((a["n"] + m).alias("n"), F.concat(a["out"], F.array(F.when(m > 0, F.substring(seq, (a["n"] + m).cast("int"), F.lit(1))).otherwise(""))).alias("out"))
    total = F.aggregate(moves, F.lit(0).cast("bigint"), lambda a, m: a + m)
    return F.when(total != F.length(seq), F.raise_error(F.lit("moves do not sum to the length"))).otherwise(F.aggregate(moves, begin, step, lambda a: a["out"]))


def move_slice(moves: Column, start: Column, end: Column, stride: Column) -> Column:
    """struct(tick, mv_len, sig_len) of bases [start, end) in a move table; null if none are inside."""
    hits = F.filter(F.sequence(F.lit(0), F.size(moves) - 1), lambda i: F.get(moves, i) != 0)

    def plan(h):
        x, y = F.greatest(F.lit(0), start), F.least(F.size(h), end)
        tick, last = F.get(h, x), F.get(h, y - 1)
        stop = F.coalesce(F.get(h, y), last + 1)
        n = stop - tick
        return F.when(y > x, F.struct(tick.alias("tick"), n.alias("mv_len"), (n * stride).alias("sig_len")))

    return let(hits, plan)


def recover_read(moves: Column, bases: Column) -> Column:
    """Letters where a move is above a half; unknown ones N."""
    kept = F.filter(F.arrays_zip(moves.alias("m"), bases.alias("b")), lambda z: z["m"] > 0.5)
    return F.array_join(F.transform(kept, lambda z: F.when((z["b"] >= 1) & (z["b"] <= 4), F.substring(F.lit("ACGT"), z["b"].cast("int"), F.lit(1))).otherwise("N")), "")


def argmax(values: Column) -> Column:
    """0-based place of the first largest."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(values: Column) -> Column:
    return let(F.array_max(values), lambda m: let(F.transform(values, lambda x: F.exp(x - m)), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(e, lambda x: x / s))))


def log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def rows_of(values: Column, width: int) -> Column:
    """A flat array as rows of a width; a rest is dropped."""
    n = F.floor(F.size(values) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * width + 1, width))).otherwise(F.array())


def greedy_ctc(labels: Column, alphabet: str = "ACGT") -> Column:
    """Labels without blanks (0) and without repeats that no blank parts, as letters; unknown ones N."""
    kept = F.filter(labels, lambda x, i: (x != 0) & ((i == 0) | ~F.get(labels, i - 1).eqNullSafe(x)))
    return F.array_join(F.transform(kept, lambda x: F.when(x.between(1, len(alphabet)), F.substring(F.lit(alphabet), x.cast("int"), F.lit(1))).otherwise("N")), "")


def clean(values: Column) -> Column:
    """NaN and infinities as 0."""
    return F.transform(values, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x))


def padded(values: Column, n: Column, fill=0) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill).cast("double"), F.greatest(n - F.size(values), F.lit(0))))


def genotype(format_: Column, sample: Column, alts: Column, policy: str = "phased") -> tuple[Column, Column]:
    """ALT of each haplotype by the GT field; '' for reference, missing or '*'.

    phased: only a|b. unphased: the least non-reference allele of a/b for both. any: a|b, a/b and haploid as they stand.
    """
    gt = F.get(F.split(sample, ":"), (F.array_position(F.split(format_, ":"), "GT") - 1).cast("int"))
    alt = F.split(alts, ",")
    pick = lambda t: F.coalesce(F.nullif(F.when(F.coalesce(t.try_cast("int"), F.lit(0)) > 0, F.get(alt, t.try_cast("int") - 1)), F.lit("*")), F.lit(""))
    a, b = F.get(F.split(gt, r"[|/]"), F.lit(0)), F.get(F.split(gt, r"[|/]"), F.lit(1))
    bar = F.instr(gt, "|") > 0
    if policy == "phased":
        return F.when(bar, pick(a)).otherwise(""), F.when(bar, pick(b)).otherwise("")
    if policy == "any":
        return pick(a), F.when(b.isNull(), pick(a)).otherwise(pick(b))
    least = F.array_min(F.filter(F.transform(F.split(gt, r"[|/]"), lambda t: t.try_cast("int")), lambda x: x > 0)).cast("string")
    return F.when(bar, pick(a)).otherwise(pick(least)), F.when(bar, pick(b)).otherwise(pick(least))


#: The letters of 4-bit base codes (fixed values of BAM), and what a code of the four bases stands for.
NIBBLES, BASES = "=ACMGRSVTWYHKDBN", "ACGT"


def from_nibbles(codes: Column) -> Column:
    """Letters of an array of 4-bit codes."""
    return F.array_join(F.transform(codes, lambda x: F.substring(F.lit(NIBBLES), x.cast("int") + 1, F.lit(1))), "")


def base_codes(seq: Column, unknown: int = 4) -> Column:
    """A, C, G, T in any case as 0 to 3, others as `unknown`."""
    if not 0 <= unknown <= 9:
        return F.transform(letters(F.upper(seq)), lambda x: F.coalesce(F.nullif(F.instr(F.lit(BASES), x), F.lit(0)) - 1, F.lit(unknown)))
    digits = F.translate(F.regexp_replace(F.upper(seq), f"[^{BASES}]", str(unknown)), BASES, "0123")
    return F.when(digits == "", F.array().cast("array<int>")).otherwise(F.split(digits, "").cast("array<int>"))


def from_base_codes(codes: Column) -> Column:
    """0 to 3 as letters, others as N."""
    spaced = F.array_join(codes.cast("array<string>"), " ", "N")
    return F.translate(F.regexp_replace(spaced, r"(?<!\S)(?![0-3](?!\S))\S+", "N"), "0123 ", BASES)


def one_hot(codes: Column, width: int = 4) -> Column:
    """A row of 0.0 and one 1.0 for each code; codes outside 0 to width - 1 have no 1.0."""
    places = F.array(*map(F.lit, range(width)))
    return F.transform(codes, lambda x: F.transform(places, lambda p: F.when(x == p, 1.0).otherwise(0.0)))


def runs_text(runs: Column) -> Column:
    """array<struct<char, n>> written out; runs without length or letter are left out, and null if nothing is left."""
    kept = F.filter(runs, lambda r: r.isNotNull() & r["char"].isNotNull() & (F.coalesce(r["n"], F.lit(0)) > 0))
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda r: F.repeat(r["char"], r["n"].cast("int"))), ""))


def masked_rows(rows: Column, mask: Column) -> Column:
    """Rows at places where the mask holds."""
    return F.filter(rows, lambda r, i: F.coalesce(F.get(mask, i), F.lit(False)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def entropy(weights: Column, least: float = 1e-6) -> Column:
    """- sum of w log w, with w at least `least` inside the logarithm."""
    return -F.aggregate(F.transform(weights, lambda w: w * F.log(F.greatest(w, F.lit(least)))), F.lit(0.0), lambda s, x: s + x)


def weighted_variance(weights: Column, vectors: Column) -> Column:
    """Mean over the components of the weighted variance of vectors around their weighted mean; vectors have one length."""
    width = F.sequence(F.lit(0), F.size(F.get(vectors, F.lit(0))) - 1)

    def one(k):
        column = F.transform(vectors, lambda v: F.get(v, k))
        return let(dot(weights, column), lambda m: dot(weights, F.transform(column, lambda x: (x - m) * (x - m))))

    return F.aggregate(F.transform(width, one), F.lit(0.0), lambda s, x: s + x, lambda s: s / F.size(width))


def duration_target(attention: Column, moves: Column, weights: Column, mask: Column) -> Column:
    """For each query: the sum over reads of weight * attention . moves, 0 outside the mask, kept inside 0 to 1.

    attention: reads x queries x time; moves: reads x time; weights: reads; mask: queries.
    """
    reads = F.sequence(F.lit(0), F.size(weights) - 1)

    def query(m, q):
        each = F.transform(reads, lambda r: F.get(weights, r) * dot(F.get(F.get(attention, r), q), F.get(moves, r)))
        return F.when(m, F.least(F.greatest(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)

    return F.transform(mask, query)


def fits_frames(items: Column, frames: Column) -> Column:
    """Whether a decoder with so many frames can give out the label sequence."""
    return ctc_length(items) <= frames


def mapped_well(mapq: Column, least: int = 20) -> Column:
    return mapq >= least


def reference_row_of(name: Column) -> Column:
    """The haplotype (hap1 or hap2) of names of reference rows, null for those of reads."""
    hap = F.regexp_extract(name, r"^REFERENCE_.*_(hap[12])$", 1)
    return F.nullif(hap, F.lit(""))
