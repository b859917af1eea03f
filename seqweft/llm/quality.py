"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule has a score and a fixed list of cutoffs from lenient to strict. Good labelled documents are counted once for
each group of copies (those that share the smallest or the largest hash of their 8-word windows) and dealt by a hash
of their ids in two parts. The first, a quarter, makes a path of settings of all rules, from lenient to strict: of each rule
the strictest cutoff that rejects no more than a share q of this part, for growing q, and before those some steps that
are more lenient. The second, the holdout, tests the settings in the order of the path, which it had no part in: a
setting holds for a stratum if the exact one-sided binomial (Clopper-Pearson) bound on the share of good documents that
all rules together reject is at most RISK; the first that fails ends the trial (fixed-sequence testing, which needs no
correction for the length of the path). Strata share the error probability by Bonferroni, so with probability
1 - DELTA no stratum loses more than RISK of its good texts, copies counted once. With all of a stratum's level, some 220
good texts in the holdout are the fewest that can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, stash

#: False rejection allowed in each stratum by all rules together, and the probability that the promise fails.
RISK, DELTA = 0.02, 0.05
#: Strata of the column lang (a parameter); all other values and null form one more, "other".
STRATA = ("de", "en", "es", "fr")
#: Cutoffs of each rule from lenient to strict; a document is rejected by score > cutoff.
CUTOFFS = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01),
    "bangs_per_word": (2.0, 1.0, 0.9, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25),
    "repeated_line_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "mean_word_chars": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0),
}
#: Shares of the first part that a rule may reject, along the path; steps (cutoffs) that the path begins before the first.
SHARES, LENIENT = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02), (4, 3, 2, 1)
#: Words of a window whose repetition within a text counts.
WINDOW = 8


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words covered by windows found twice or more in the text: those that share a hash are held against each other by their strings."""
    equal = lambda s, x, k, c: F.coalesce(F.get(s, k - 1)[c] == x[c], F.lit(False)) | F.coalesce(F.get(s, k + 1)[c] == x[c], F.lit(False))
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    likely = _let(placed, lambda s: F.filter(s, lambda x, k: equal(s, x, k, "h")))
    strings = F.sort_array(F.transform(likely, lambda x: F.struct(F.array_join(F.slice(words, x["i"] + 1, WINDOW), " ").alias("g"), x["i"].alias("i"))))
    twice = _let(strings, lambda s: F.filter(s, lambda x, k: equal(s, x, k, "g")))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end"))
    return F.aggregate(places, begin, step, lambda a: a["n"])


def with_features(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs with a struct of the base counts and the rules' scores.

    A repeated window is first looked for by 64-bit hashes of its words' hashes, which never miss one; only windows whose
    hash repeats make strings. Null texts have no words; empty denominators give a score of 0.
    """
    t, w, h = (f"{name}_{x}" for x in "twh")
    df = docs.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn(w, F.regexp_extract_all(F.col(t), F.lit(WORD), F.lit(0)))
    places = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = _let(F.transform(w, lambda x: F.xxhash64(x)), lambda v: F.transform(places, lambda i: F.xxhash64(F.slice(v, i + 1, WINDOW))))
    df = df.withColumn(h, F.when(F.size(w) > WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike(SPACE.replace("[", "[^")))
    count = lambda p: F.size(F.regexp_extract_all(F.col(t), F.lit(p), F.lit(0))).cast("long")
    df = df.withColumn(
        name,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            count(r"[#*$%&|<>]").alias("n_symbols"),
            _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            F.when(F.size(F.array_distinct(h)) < F.size(h), _repeat_words(F.col(w), F.col(h))).otherwise(0).cast("long").alias("n_repeat_words"),
            count("!").alias("bangs"),
            count(r"\p{Lu}").alias("upper"),
            F.coalesce(F.array_min(h), F.xxhash64(w)).alias("lo"),
            F.coalesce(F.array_max(h), F.xxhash64(w)).alias("hi"),
        ),
    )
    return df.drop(t, w, h)


def scores(f: Column) -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {
        "symbol_share": share(f["n_symbols"], f["word_chars"]),
        "bangs_per_word": share(f["bangs"], f["n_words"]),
        "upper_share": share(f["upper"], f["word_chars"]),
        "repeated_line_share": share(f["lines"]["dup"], f["lines"]["n"]),
        "mean_word_chars": share(f["word_chars"], f["n_words"]),
    }


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def stratum(lang: Column, strata=STRATA) -> Column:
    return F.when(lang.isin(*strata), lang).otherwise("other")


def _log_binomial(n: Column, k: Column, p: float) -> Column:
    """log P(X = k), from the exact product."""
    terms = F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))))
    log_choose = F.aggregate(terms, F.lit(0.0), lambda a, j: a + F.log((n - j + 1).cast("double")) - F.log(j.cast("double")))
    return log_choose + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))


def lower_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p): the largest term times the sum of the ratios below it."""
    odds = (1 - p) / p
    down = F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.greatest(k, F.lit(1)), F.lit(1).cast("long"), F.lit(-1).cast("long")))
    begin = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def step(a, j):
        term = a["term"] * j.cast("double") / (n - j + 1).cast("double") * odds
        return F.struct((a["sum"] + term).alias("sum"), term.alias("term"))

    return F.exp(_log_binomial(n, k, p)) * F.aggregate(down, begin, step, lambda a: a["sum"])


def _path(n: int, counts: dict[str, list[int]], cutoffs: dict[str, tuple[float, ...]]) -> list[list[float | None]]:
    """Settings (of each rule its cutoff, or None) from lenient to strict. counts: of each rule and cutoff the rejected ones of n."""
    last = lambda k, q: sum(c <= q * n for c in counts[k]) - 1
    steps = [[last(k, 0) - m for k in cutoffs] for m in LENIENT] + [[last(k, q) for k in cutoffs] for q in SHARES]
    out: list[list[float | None]] = []
    for step in steps:
        setting = [c[i] if i >= 0 else None for i, c in zip(step, cutoffs.values(), strict=True)]
        if any(x is not None for x in setting) and (not out or setting != out[-1]):
            out.append(setting)
    return out


def thresholds(scored: DataFrame, labels: DataFrame, name: str, id_col: str = "doc_id", lang_col: str = "lang", strata=STRATA, cutoffs=None, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n, rejected): the strictest setting that holds, and of n texts of the holdout those that all its rules reject; no row where none does.

    labels: doc_id, quality; a document is good if all its labels are 1. All good ones count, copies and repeated rows
    once. The result has at most a row for each stratum and rule.
    """
    cutoffs = cutoffs or CUTOFFS
    good = labels.groupBy(F.col("doc_id").alias("label_id_")).agg(F.min("quality").alias("quality_")).where("quality_ = 1").select("label_id_")
    f = F.col(name)
    values = scores(f)
    rows = scored.select(F.col(id_col).alias("id_"), stratum(F.col(lang_col), strata).alias("stratum"), F.array(*(values[k] for k in cutoffs)).alias("s"), f["lo"].alias("lo"), f["hi"].alias("hi"))
    rows = rows.join(good, rows.id_ == good.label_id_)
    spot = F.struct(F.xxhash64("id_").alias("h"), F.col("id_").cast("string").alias("id"), "s", "lo", "hi")
    for end in ("lo", "hi"):  # one of each group of copies stays, by the hash of its id
        rows = rows.groupBy("stratum", end).agg(F.min(spot).alias("x")).select("stratum", F.col("x.id").alias("id_"), "x.s", "x.lo", "x.hi")
    rows = stash(rows.select("stratum", "s", (F.pmod(F.xxhash64("id_", F.lit(7)), F.lit(4)) == 0).alias("first")), "good")
    above = [F.sum(F.when(F.col("s")[r] > c, 1).otherwise(0)).cast("long").alias(f"{k}:{i}") for r, (k, cs) in enumerate(cutoffs.items()) for i, c in enumerate(cs)]
    seen = rows.where("first").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *above).collect()  # a row for each stratum
    tested = [r["stratum"] for r in rows.where("not first").groupBy("stratum").agg(F.count(F.lit(1))).collect()]
    paths = {r["stratum"]: _path(r["n"], {k: [r[f"{k}:{i}"] for i in range(len(cs))] for k, cs in cutoffs.items()}, cutoffs) for r in seen}
    paths = {k: p for k, p in paths.items() if p and k in tested}
    kind = "array<array<double>>"
    path = F.lit(None).cast(kind)
    for k, p in sorted(paths.items()):
        path = F.when(F.col("stratum") == k, F.array(*(F.array(*(F.lit(x).cast("double") for x in setting)) for setting in p))).otherwise(path)
    rows = rows.where("not first").select("stratum", "s", F.posexplode(path).alias("i", "setting"))
    hit = F.exists(F.zip_with("s", "setting", lambda x, c: F.coalesce(x > c, F.lit(False))), lambda x: x)
    tried = rows.groupBy("stratum", "i", "setting").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("rejected"))
    can = F.col("rejected") < F.col("n") * risk  # else the bound is above the risk, and the sum would be long
    tail = lower_tail(F.col("n"), F.when(can, F.col("rejected")).otherwise(F.lit(0).cast("long")), risk)
    tried = tried.withColumn("holds", can & (tail <= delta / max(len(tested), 1)))
    so_far = Window.partitionBy("stratum").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    tried = tried.withColumn("all_hold", F.min("holds").over(so_far)).where("all_hold")
    best = tried.groupBy("stratum").agg(F.max(F.struct("i", "setting", "n", "rejected")).alias("b")).select("stratum", "b.*")
    each = F.arrays_zip(F.array(*map(F.lit, cutoffs)).alias("rule"), F.col("setting").alias("cutoff"))
    return best.select("stratum", F.explode(each).alias("x"), "n", "rejected").select("stratum", F.col("x.rule").alias("rule"), F.col("x.cutoff").alias("cutoff"), "n", "rejected").where("cutoff is not null")


def rejected(f: Column, lang: Column, chosen: list, strata=STRATA) -> Column:
    """Whether the method rejects a document. chosen: rows of thresholds()."""
    out = F.lit(False)
    at = stratum(lang, strata)
    for rule, score in scores(f).items():
        for r in sorted((r for r in chosen if r["rule"] == rule), key=lambda r: r["stratum"]):
            out = out | ((at == r["stratum"]) & (score > r["cutoff"]))
    return out


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the method's verdict for every row.

    Counts are made once, into a narrow table of the shared folder; thresholds (at most a row for each stratum and rule)
    become literals. Null or empty texts fail the base; null or unknown languages are the stratum "other"; without enough
    labels a stratum has no thresholds and the method keeps all of it. Repeated rows repeat; other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    scored = stash(with_features(src, "f").drop("text"), "quality")
    chosen = thresholds(scored, labels, "f", "doc_id", "lang", **options).collect()
    f, failed = F.col("f"), base_failed(F.col("f"))
    bad = rejected(f, F.col("lang"), chosen, options.get("strata", STRATA))
    base = [f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols")] + [f["lines"]["dup"].alias("n_dup_lines"), f["n_repeat_words"].alias("n_repeat_words")]
    return scored.select("doc_id", *base, failed.alias("base_failed"), (~failed & ~bad).alias("kept"), bad.alias("rule_rejected"))


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of docs that pass the base and the rules, with all their columns."""
    name = "quality_"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    scored = stash(with_features(docs, name, text_col), "quality")
    chosen = thresholds(scored, labels, name, id_col, lang_col, **options).collect()
    f = F.col(name)
    return scored.where(~base_failed(f) & ~rejected(f, F.col(lang_col), chosen, options.get("strata", STRATA))).select(*docs.columns)
