"""Toxicity: cumulative-link ordinal regression over sparse text features, with weights shared by the ordered thresholds.

P(grade <= k) = sigmoid(theta_k - w.x); the expected severity is the sum over k of P(grade > k). Features say which
letter runs (lower-cased) and which beginnings of letter runs a text has, hashed into a fixed space.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .textscan import OTHERS, Words, pieces

#: Hashed feature space, and the beginnings (bytes) of letter runs that are features beside whole runs.
SPACE_BITS, PREFIXES = 20, (4, 5, 6)
#: Bounds of the fit: labelled documents that it uses at most, features that it gives a weight at most.
SAMPLE, FEATURES = 20_000, 4_096
#: A feature is used if more toxic than other documents have it by an exact test; at most about this share of the used ones is there by chance.
CHANCE = 0.05
#: A document has the highest grade that it reaches with this probability: one word of its own is evidence enough where no clean document has it.
GRADE_AT = 0.2
#: Different grades that labels may have.
MOST_GRADES = 20
#: Ridge penalty and steps of the fit.
RIDGE, STEPS = 3e-6, 600


def _features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), with repeats."""
    w = Words(data, offs, OTHERS)
    mask, row = np.uint64((1 << SPACE_BITS) - 1), w.row()
    size = w.end - w.start
    rows, found = [], []
    for n, h in zip((0, *PREFIXES), w.hashes(True, PREFIXES), strict=True):
        use = size >= n if n else size > 0
        rows.append(row[use])
        found.append(((h[use] + np.uint64(n * 0x9E3779B1)) & mask).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def _distinct(data: np.ndarray, offs: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    row, f = _features(data, offs)
    if table is not None:
        hit = table[f] != 0
        row, f = row[hit], f[hit]
    both = np.unique(row << SPACE_BITS | f)
    return both >> SPACE_BITS, both & ((1 << SPACE_BITS) - 1)


def log_upper_tail(a: np.ndarray, b: np.ndarray, bad: int, good: int) -> np.ndarray:
    """log P(A >= a), A the toxic ones of a + b documents drawn from bad toxic and good clean ones (Fisher's exact test)."""
    lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, bad + good + 1)))])
    choose = lambda n, k: lf[n] - lf[k] - lf[n - k]
    total, term, x = np.ones(len(a)), np.ones(len(a)), a.astype(float)
    while (term > 1e-12 * total).any():  # ratios fall and reach 0 at the largest count
        term = term * np.maximum(bad - x, 0) * np.maximum(a + b - x, 0) / ((x + 1) * np.maximum(good - (a + b) + x + 1, 1))
        total += term
        x += 1
    return choose(bad, a) + choose(good, b) - choose(bad + good, a + b) + np.log(total)


def associated(a: np.ndarray, b: np.ndarray, bad: int, good: int, most: int = FEATURES, chance: float = CHANCE) -> np.ndarray:
    """Places of the features that a toxic and b clean documents have, surest first, whose share of chance finds is bounded (Benjamini-Hochberg)."""
    more = np.flatnonzero(a * good > b * bad)
    pairs, back = np.unique(a[more] * (good + 1) + b[more], return_inverse=True)
    p = log_upper_tail(pairs // (good + 1), pairs % (good + 1), bad, good)[back]
    by = np.argsort(p, kind="stable")
    hold = np.flatnonzero(p[by] <= np.log(chance * np.arange(1, len(by) + 1) / max(len(a), 1)))
    return more[by[: min(hold[-1] + 1, most)]] if len(hold) else more[:0]


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, size: int, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(w, theta) by full-batch gradient steps with momentum; thresholds are kept in order by their positive gaps."""
    k = max(int(grades.max()), 1) if len(grades) else 1
    n = len(grades)
    lens = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(n), lens)
    flat = np.concatenate(rows) if n else np.zeros(0, np.int64)
    w, first, gaps = np.zeros(size), 0.0, np.zeros(k - 1)
    moment = [np.zeros(size), 0.0, np.zeros(k - 1)]
    square = [np.zeros(size), 0.0, np.zeros(k - 1)]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        theta = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        eta = np.bincount(owner, w[flat], n)
        cum = np.hstack([np.zeros((n, 1)), sig(theta[None, :] - eta[:, None]), np.ones((n, 1))])
        slope = cum * (1 - cum)
        p = np.maximum(cum[np.arange(n), grades + 1] - cum[np.arange(n), grades], 1e-12)
        hi, lo = slope[np.arange(n), grades + 1] / p, slope[np.arange(n), grades] / p
        d_eta = (hi - lo) / n
        d_theta = np.array([(-hi[grades == j].sum() + lo[grades == j + 1].sum()) / n for j in range(k)])
        d_gaps = np.array([d_theta[j + 1 :].sum() * np.exp(gaps[j]) for j in range(k - 1)])
        grad = [np.bincount(flat, d_eta[owner], size) + ridge * w, d_theta.sum(), d_gaps]
        for i, (g, rate) in enumerate(zip(grad, (0.1, 0.1, 0.05), strict=True)):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            move = rate * (moment[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8)
            if i == 0:
                w = w - move
            elif i == 1:
                first = first - float(move)
            else:
                gaps = gaps - move
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def _arrow(batches, per_piece, names, id_at):
    for b in batches:
        for at, data, offs in pieces(b.column("text")):
            cols = per_piece(data, offs)
            yield pa.RecordBatch.from_arrays([b.column(id_at).slice(at, len(offs) - 1), *cols], names)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(weights over the hashed space, thresholds). labels: doc_id, toxic, an integer of any type; a document has the highest of its labels.

    The labels' own values are the grades, in their order: K + 1 different ones make K thresholds, and the lowest is
    clean. The sample takes clean and toxic documents by the smallest hashes of their ids: toxic ones up to half of it,
    or more where clean ones do not fill the rest. Thresholds are moved back to the shares of clean and toxic in labels.
    Without labels of both kinds, or where no feature tells them apart, no document is toxic, and a warning says so.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    values = [r["toxic"] for r in known.select("toxic").distinct().orderBy("toxic").limit(MOST_GRADES + 1).collect()]
    if len(values) > MOST_GRADES:
        raise ValueError(f"labels have more than {MOST_GRADES} grades")
    nothing = np.zeros(1 << SPACE_BITS, np.float32), np.full(max(len(values) - 1, 1), 20.0)
    if len(values) < 2:
        warnings.warn("labels of one grade only: no document will be called toxic", stacklevel=2)
        return nothing
    known = known.withColumn("toxic", F.array_position(F.array(*map(F.lit, values)), F.col("toxic")).cast("int") - 1)
    sizes = known.agg(F.count_if(F.col("toxic") > 0).alias("bad"), F.count_if(F.col("toxic") <= 0).alias("good")).first()
    take_bad = min(sizes["bad"], max(sample // 2, sample - sizes["good"]))
    take_good = min(sizes["good"], sample - take_bad)
    pick = lambda which, n: known.where(which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    known = pick("toxic > 0", take_bad).unionByName(pick("toxic <= 0", take_good)).select(F.col("doc_id").alias("label_id_"), "toxic")
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = stash(chosen.join(F.broadcast(known), F.col("doc_id") == F.col("label_id_")).select("toxic", "text"), "labelled")  # of at most `sample` documents

    def having(batches):
        def lists(data, offs):
            row, f = _distinct(data, offs)
            ends = np.searchsorted(row, np.arange(len(offs)))
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f.astype(np.int32)))]

        yield from _arrow(batches, lists, ["toxic", "f"], "toxic")

    with_features = chosen.mapInArrow(having, "toxic int, f array<int>")
    total = {r["toxic"]: r["n"] for r in with_features.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        warnings.warn("labelled documents of one kind only: no document will be called toxic", stacklevel=2)
        return nothing
    df = with_features.select((F.col("toxic") > 0).alias("t"), F.explode("f").alias("f")).groupBy("f").agg(F.sum(F.col("t").cast("long")).alias("a"), F.sum((~F.col("t")).cast("long")).alias("b"))
    seen = df.orderBy("f").toArrow()  # at most 2^SPACE_BITS rows of three numbers
    f, a, b = (seen[c].to_numpy() for c in "fab")
    best = f[associated(a, b, bad, good)]
    if not len(best):
        warnings.warn("no feature tells toxic documents from clean ones: no document will be called toxic", stacklevel=2)
        return nothing
    place = np.full(1 << SPACE_BITS, 0, np.int32)
    place[best] = np.arange(1, len(best) + 1)
    spread = docs.sparkSession.sparkContext.broadcast(place)

    def vectors(batches):
        def lists(data, offs):
            row, f = _distinct(data, offs, spread.value)
            ends = np.searchsorted(row, np.arange(len(offs)))
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(spread.value[f] - 1, pa.int32()))]

        yield from _arrow(batches, lists, ["toxic", "f"], "toxic")

    got = chosen.mapInArrow(vectors, "toxic int, f array<int>").collect()  # at most `sample` rows of at most FEATURES
    rows = [np.array(r["f"], np.int64) for r in got]
    grades = np.array([r["toxic"] for r in got])
    w, theta = fit_ordinal(rows, grades, len(best))
    table = np.zeros(1 << SPACE_BITS, np.float32)
    table[best] = w
    return table, theta + np.log(sizes["good"] / take_good) - np.log(sizes["bad"] / take_bad)


def score_toxicity(docs: DataFrame, weights: np.ndarray, theta: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity, p_toxic, grade, toxic for every whole text. grade is the rank of the labels' grade, 0 for clean.

    weights is of the fixed size 2^SPACE_BITS. Null and empty texts have no features and get the base rate. Rows are
    judged alone: repeated rows repeat; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast((weights, theta))

    def work(batches):
        table, cuts = model.value

        def judge(data, offs):
            row, f = _distinct(data, offs, table)
            eta = np.bincount(row, table[f], len(offs) - 1)
            above = 1 / (1 + np.exp(-np.clip(eta[:, None] - cuts[None, :], -60, 60)))
            grade = (above >= GRADE_AT).sum(1)
            return [pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(grade.astype(np.int32)), pa.array(grade > 0)]

        yield from _arrow(batches, judge, ["doc_id", "expected_severity", "p_toxic", "grade", "toxic"], "doc_id")

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(work, f"doc_id {kind}, expected_severity double, p_toxic double, grade int, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score_toxicity of all docs by a model that is fitted on those that have labels.

    Labels of unknown documents and labels without a value are ignored; rows that repeat count as often as they stand in
    docs; an empty table gives no rows, and a table without usable labels the verdict that nothing is toxic.
    """
    return score_toxicity(docs, *fit(docs, labels, id_col, text_col), id_col, text_col)
