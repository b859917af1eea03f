"""Operators over texts against brute force, with nulls, empty and repeated rows, ties and clashing column names."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweft.llm import exactdedup, graph, neardup, pii, quality, queries, substring, textscan, toxicity

SF = "/root/testdata/sf0.01"

WORD = re.compile(r"[^ \t-\r]+")
EDGE = [None, "", " \n\t ", "a", "a  b\tc", "a b c", "A b C", "é ÉÀ ß\u00a0x 日本"]


def corpus(seed=1):
    """Rows (doc_id, text) with exact and near copies, shared passages and edge cases."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    texts = list(EDGE)
    passage = prose(60)
    for _ in range(25):
        base = prose(rnd.randint(30, 200))
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            near = list(base)
            for _ in range(rnd.randint(0, 5)):
                near[rnd.randrange(len(near))] = rnd.choice(words)
            texts.append(rnd.choice([" ", "\n", "  "]).join(near))
        if rnd.random() < 0.5:
            texts.append(" ".join([*prose(20), *passage, *prose(20)]))
    texts += [" ".join(["x"] * 90), " ".join(["p", "q"] * 50), texts[10], " ".join(prose(30_000))]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    more = [(i, t, "k", 1, "h", 0) for i, t in rows]
    return spark.createDataFrame(more, "doc_id long, text string, key string, mark int, digest string, n int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def norm(t):
    return re.sub(r"[ \t-\r]+", " ", t or "")


def test_exact(docs, rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = {(i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}
    assert {tuple(r) for r in exactdedup.exact_groups(docs).collect()} == want
    assert exactdedup.exact_dedup(docs).count() == len(groups)
    assert exactdedup.exact_dedup(docs).columns == docs.columns


def test_exact_survives_colliding_digests(docs, rows):
    same = lambda c: F.lit("same")
    got = exactdedup.exact_groups(docs, digest=same, confirm=same)
    groups = collections.Counter(norm(t) for _, t in rows)
    size = dict(rows)
    assert all(r.group_size == groups[norm(size[r.doc_id])] for r in got.collect())


def test_exact_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    got = sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in exactdedup.exact_groups(df).collect())
    assert got == ["(3, 3, 3, True)", "(3, 3, 3, True)", "(None, 3, 3, False)", "(None, None, 1, True)"]


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_brute(rows, similar=85):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                    m = min(comp[a], comp[b])
                    old = {comp[a], comp[b]}
                    comp = {i: m if c in old else c for i, c in comp.items()}
                    changed = True
    return {(i, len(sets[i]), comp[i], comp[i] == i) for i in sets}


@pytest.mark.parametrize("most", [1000, 3])
def test_near(docs, rows, most, monkeypatch):
    monkeypatch.setattr(neardup, "MOST_SETS", most)
    monkeypatch.setattr(neardup, "CHUNK", 3)
    want = near_brute(rows)
    assert {tuple(r) for r in neardup.near_groups(docs).collect()} == want
    kept = neardup.near_dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, _, keep in want if keep}


@pytest.mark.parametrize("most", [1, 4])
def test_near_chains(spark, most, monkeypatch):
    """Drifting versions: neighbours are linked, far ones are not, and whoever is the hub only reaches some of them."""
    monkeypatch.setattr(neardup, "MOST_SETS", most)
    monkeypatch.setattr(neardup, "CHUNK", 2)
    rnd = random.Random(11)
    rows = []
    for chain in range(3):
        text = [f"c{chain}w{k}" for k in range(120)]
        for step in range(25):
            for k in rnd.sample(range(120), 2 if step % 9 else 5):
                text[k] = f"c{chain}s{step}w{k}"
            rows.append((len(rows), " ".join(text)))
    rnd.shuffle(rows)
    got = {tuple(r) for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == near_brute(rows) and len({c for _, _, c, _ in got}) > 3


def test_near_by_bytes(spark, monkeypatch):
    """Long words that powers of one base mod 2^64 cannot tell apart; and hashes that all clash link nothing."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, a), (2, a.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_groups(df).collect()} == {(1, 1), (2, 2)}
    same = [np.arange(1, 30, dtype=np.uint64)] * 3
    texts = [" ".join(f"{x}{k}" for k in range(33)) for x in "aba"]
    assert neardup.forest(same, 85, None, neardup._confirmed(texts, 85)) == [(2, 0)]


def test_dedup_odd_ids(spark):
    """Null, repeated and string ids: one row of each group stays, and no text is lost."""
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, "q"), (None, "q"), (3, "q"), (3, "a a a"), (2, "a a a"), (2, "a a a"), (None, "lone"), (None, t), (9, t + " 1"), (9, t), (4, None), (5, "")]
    for kind, ids in (("long", lambda i: i), ("string", lambda i: None if i is None else f"d{i}")):
        df = spark.createDataFrame([(ids(i), x, "e") for i, x in rows], f"doc_id {kind}, text string, row_key_ string").repartition(3)
        exact = sorted(((r.doc_id, r.text) for r in exactdedup.exact_dedup(df).collect()), key=str)
        assert exact == sorted([(ids(3), "q"), (ids(2), "a a a"), (None, "lone"), (ids(9), t), (ids(9), t + " 1"), (ids(4), None)], key=str)
        near = neardup.near_dedup(df)
        got = [(r.doc_id, r.text) for r in near.collect()]
        assert near.columns == df.columns and {(ids(3), "q"), (ids(2), "a a a"), (None, "lone")} < set(got)
        assert sorted(map(str, (i for i, _ in got))) == sorted(map(str, [ids(3), ids(2), None, ids(9), ids(4), ids(5)]))
    assert {r.component_id for r in neardup.near_groups(df).where("n_shingles > 1").collect()} == {"d9"}


def test_near_odd_ids(spark, empty):
    t = "a b c d e f g h i j"
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (2, t + " k"), (7, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in neardup.near_groups(df).collect())
    assert got == [("2", 2, True), ("5", 2, False), ("5", 2, False), ("7", 7, True), ("None", 2, False)]
    assert neardup.near_groups(empty).count() == 0
    assert neardup.near_dedup(empty).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(1, 1 << 62, 400, dtype=np.uint64)
    a, b = np.sort(pool[:300]), np.sort(pool[100:])
    s = neardup.sketches([a, b, a[:1], pool[:3]])
    assert (s != neardup._FULL).all()  # each coordinate is filled, even for one element
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.15
    assert (neardup.sketches([a[:1]])[0] == s[2]).all()


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    comp = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.key: r.comp for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: c for k, c in comp.items() if k != c}


def passages_brute(rows):
    words = {i: (t or "").encode().split() for i, t in rows}
    times = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    out = set()
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if times[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        out.add((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("most", [8_000, 1])
def test_passages(docs, rows, most, monkeypatch):
    monkeypatch.setattr(substring, "MOST", most)
    assert {tuple(r) for r in substring.repeated_passages(docs).collect()} == passages_brute(rows)


def test_passages_odd_ids(spark, empty):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, t), (1, t), (1, "x " + t), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring.repeated_passages(df, with_text=True).collect())
    assert got == [("1", 40, 40, ""), ("1", 41, 40, "x"), ("2", 0, 0, None), ("None", 40, 40, "")]
    assert substring.repeated_passages(empty).count() == 0


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["ab cd\tab", "", None, " cd  ", "x" * 10, "é ab"]
    seen: dict = {}
    for at, data, offs in textscan.pieces(pa.array(texts)):
        w = textscan.Words(data, offs)
        h = w.hashes()[0].tolist()
        for r in range(len(offs) - 1):
            own = (texts[at + r] or "").encode().split()
            assert int(w.first[r + 1] - w.first[r]) == len(own)
            for word, v in zip(own, h[w.first[r] : w.first[r + 1]], strict=True):
                assert seen.setdefault(word, v) == v
    assert len(set(seen.values())) == len(seen)


def test_runs_are_order_sensitive():
    h = np.arange(1, 50, dtype=np.uint64)
    for n in (1, 2, 5, 8, 35):
        r = textscan.runs(h, n)
        assert len(r) == 50 - n and len(set(r.tolist())) == len(r)
    assert textscan.runs(h[:2], 2)[0] != textscan.runs(h[:2][::-1].copy(), 2)[0]


def base_brute(t):
    def luhn(d):
        s = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(d[::-1])]
        return sum(x - 9 if x > 9 else x for x in s) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15],
    ]


def test_base_spans_fuzzed():
    rnd = random.Random(5)
    for alphabet in ("ab1239@@..+- ()%\n", "0123456789 -", "1.@a+"):
        for _ in range(4000):
            t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            assert pii.base_spans(t) == base_brute(t), t
    assert pii.base_spans("4111 1111 1111 1111")[2] == [(0, 19)]
    for t in ("0" * 60 + "1.1.1.1", "0" * 4000 + ".0.0.255", "1.1.1." + "0" * 80 + "256", "1.2.3.4444"):
        assert pii.base_spans(t) == base_brute(t), t


def test_contexts_discover_identifiers(spark, empty):
    rows = [(i, f"please call me at {7000000 + i * 37} tomorrow" if i % 3 == 0 else f"please call me at +1 (555) 555-{1000 + i} tomorrow") for i in range(60)]
    rows += [(100, "room 1234567 here"), (101, None), (102, ""), (103, "please call me at 030 1234 567 tomorrow"), (103, "room 12-34-567"), (None, "please call me at 7000000 tomorrow")]
    rows += [(200 + i, f'set token = "{hashlib.md5(str(i).encode()).hexdigest()}" there') for i in range(40)] + [(300, "set token = a1b2.c3d4 there"), (301, "the a1b2.c3d4 again"), (302, "the e5f6.a7b8 part")]
    rows += [(400 + i, f"write to w{i}@mail.example.com please") for i in range(40)] + [(500, "write to bob@intranet please"), (501, "write to ann (at) host (dot) com please")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kind string").repartition(3)
    got = collections.defaultdict(list)
    for r in pii.find_personal_data(df).collect():
        got[r.doc_id].append(r.spans)
    assert got[0] == ["phone:18:25"] and got[1] == ["phone:18:35"] and got[100] == got[101] == got[102] == [""] and sorted(got[103]) == ["", "phone:18:30"] and got[None] == ["phone:18:25"]
    assert got[200] == ["secret:13:45"] and got[300] == ["secret:12:21"] and got[301] == ["secret:4:13"] and got[302] == [""]
    assert got[400] == ["email:9:28"] and got[500] == ["email:9:21"] and got[501] == ["email:9:32"]
    clean = {r.doc_id: r.text for r in pii.redact(df).collect() if r.doc_id != 103}
    assert clean[0] == clean[1] == clean[None] == "please call me at <PHONE> tomorrow" and clean[100] == "room 1234567 here" and clean[101] is None
    assert clean[200] == 'set token = "<SECRET>" there' and clean[501] == "write to <EMAIL> please" and pii.redact(df).columns == df.columns
    assert pii.find_personal_data(empty).count() == 0 and pii.redact(empty).count() == 0


def test_candidates_cover_long_strings():
    t = "http://" + "x" * 500 + "/?id=AB12cd34&y=" + "9" * 300
    assert [t[a:b] for a, b in pii.candidates(t, [])] == ["AB12cd34", "9" * 300]
    assert all(len(p) < 300 for a, b in pii.candidates(t, []) for p in pii.Contexts(t).of(a, b))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_personal_data_of_the_table(spark):
    """The query against brute force on a whole table; planted secrets are found, and nothing else is called one."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    planted = 0
    for r in queries.op5_pii(spark, SF).collect():
        base = base_brute(docs[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, s in zip(pii.BASE, base, strict=True) for a, b in s)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(s) for s in base] and r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        want = [m.span(1) for m in re.finditer('(?i)token = "([0-9a-f]{40})"', docs[r.doc_id])]
        planted += len(want)
        assert [x for x in r.spans.split(",") if x.startswith("secret")] == [f"secret:{a}:{b}" for a, b in want]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert planted > 10


def quality_brute(t):
    t = t or ""
    w = WORD.findall(t)
    at = collections.defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, rows):
    more = [(10_000 + i, t) for i, t in enumerate(["a b\na b\n\n \na b", "x|y #* <>", "r s t u v w x y z r s t u v w x y z " * 3, "q" * 50_000])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = dict(rows) | dict(more)
    for r in quality.quality_verdicts(df, labels).collect():
        n, *rest = quality_brute(want[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[-1] > 30 * n) and r.kept == (not r.base_failed)


def test_lower_tail_is_exact(spark):
    from math import comb

    df = spark.createDataFrame([(n, k) for n in (1, 7, 60, 900) for k in (0, 1, 3, 9) if k <= n], "n long, k long")
    for p in (0.004, 0.2):
        for r in df.withColumn("t", quality.lower_tail(F.col("n"), F.col("k"), p)).collect():
            assert abs(r.t - sum(comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1))) < 1e-9


def test_thresholds_keep_their_promise(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 6 == 0
        text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) + ("!!" if bad else "") for _ in range(30))
        rows.append((i, text, "en"))
        labels.append((i, int(not bad), 0))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(df, lab).collect()}
    assert all(got[i] for i in got if i % 6) and not any(got[i] for i in got if i % 6 == 0)
    assert quality.filter_quality(df, lab).columns == df.columns
    few = lab.where("doc_id < 150")  # too few for any promise: nothing is rejected
    assert quality.filter_quality(df, few).count() == 6000
    other = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx")).withColumn("f", F.lit(1))  # unknown and null languages are one stratum
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(other, lab).collect()}
    assert all(got[i] for i in got if i % 6) and not any(got[i] for i in got if i % 6 == 0)


def features(f, **values):
    long = lambda c: (c if not isinstance(c, int) else F.lit(c)).cast("long")
    base = dict(n_symbols=0, word_chars=1, n_words=1, bangs=0, upper=0, n_repeat_words=0, lo=F.col("doc_id"), hi=F.col("doc_id")) | values
    return F.struct(*(long(v).alias(k) for k, v in base.items()), F.struct(long(0).alias("n"), long(0).alias("dup")).alias("lines")).alias(f)


def test_thresholds_count_all_good_labels(spark):
    """60,000 good documents of one stratum, of which 1.8 % have a score of 1: that can be told from 2 % with all of them only."""
    n, k = 60_000, 1_080
    scored = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang")).select("*", features("f", n_symbols=F.when(F.col("doc_id") < k, 1).otherwise(0)))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = {r.rule: r for r in quality.thresholds(scored, labels, "f").collect()}
    assert all(44_000 < r.n < 46_000 for r in got.values()) and got["symbol_share"].cutoff == min(quality.CUTOFFS["symbol_share"]) and 700 < got["symbol_share"].rejected < 900
    part = labels.where("doc_id % 20 = 0")
    assert "symbol_share" not in {r.rule for r in quality.thresholds(scored, part, "f").collect()}


def test_copies_make_no_evidence(spark):
    """100 good texts, each 100 times, with ids of their own or repeated, changed a little or not: still 100."""
    scored = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), features("f", lo=F.col("id") % 100, hi=F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") % 100)))
    labels = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.thresholds(scored, labels, "f").count() == 0
    one = scored.where("doc_id < 100").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("x")
    assert quality.thresholds(one, labels.union(labels), "f").count() == 0
    assert {r.n for r in quality.thresholds(scored.withColumn("f", F.col("f").withField("lo", F.col("doc_id")).withField("hi", F.col("doc_id"))), labels, "f").collect()} > set()


def test_toxicity_held_out(spark, empty):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("aeioulmnrst") for _ in range(6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        w = [rnd.choice(words) for _ in range(40)]
        if i % 5 == 0:
            for _ in range(rnd.randint(1, 6)):
                w[rnd.randrange(40)] = rnd.choice(["zgrobly", "zgrobber", "vuxter,", "Qworp"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(9001, None), (9002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, train).collect()}
    held = range(1000, 1500)
    assert sum(got[i].toxic != (i % 5 == 0) for i in held) <= 10
    assert not got[9001].toxic and not got[9002].toxic
    mean = lambda ids: np.mean([got[i].expected_severity for i in ids])
    assert mean(i for i in held if i % 5 == 0) > 0.5 > mean(i for i in held if i % 5)
    assert toxicity.toxicity(empty, train).count() == 0
    assert not any(r.toxic for r in toxicity.toxicity(df, train.limit(0)).collect())


def test_toxic_word_in_few_documents_counts(spark):
    """12 toxic documents of a small table, and 12 in 4,012 labels of which a sample of 500 by class is fitted."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("aeioulmnrst") for _ in range(6)) for _ in range(400)]
    for n, sample in ((100, toxicity.SAMPLE), (4000, 500)):
        rows = [(i, " ".join(rnd.choice(words) for _ in range(30)) + (" zgrobly" if i < 16 else "")) for i in range(n + 16)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(i, 1, int(i < 12)) for i in range(n + 16) if not 12 <= i < 16], "doc_id long, quality int, toxic int")
        got = toxicity.score_toxicity(df, *toxicity.fit(df, labels, sample=sample)).where("toxic").collect()
        assert {r.doc_id for r in got} == set(range(16)) and all(r.grade > 0 for r in got)


def test_toxicity_uses_given_grades(spark):
    """Four grades in a long column, each with a word of its own; repeated rows, clashing columns, labels without documents."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("aeioulmnrst") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(800):
        grade = (0, 0, 0, 0, 0, 1, 2, 5)[i % 8]
        more = {0: "", 1: " zgrobly", 2: " zgrobly vuxter", 5: " zgrobly vuxter qwirp"}[grade]
        rows.append((i, " ".join(rnd.choice(words) for _ in range(25)) + more, 7, 7))
        labels.append((i, grade))
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, toxic int, grade int")
    lab = spark.createDataFrame([*labels, (None, 5), (10**6, 5), (1, None)], "doc_id long, toxic long")
    weights, theta = toxicity.fit(df, lab)
    assert len(theta) == 3 and (np.diff(theta) > 0).all()
    got = toxicity.score_toxicity(df, weights, theta).collect()
    assert len(got) == 803
    rank = {0: 0, 1: 1, 2: 2, 5: 3}
    assert sum(r.grade != rank[labels[r.doc_id][1]] for r in got) <= 40 and all(r.toxic == (r.grade > 0) for r in got)
    mean = [np.mean([r.expected_severity for r in got if labels[r.doc_id][1] == g]) for g in rank]
    assert mean == sorted(mean)

    def features(t):
        out = set()
        for w in re.findall("[a-z0-9]+", t.lower()):
            for n, part in [(0, w), *((n, w[:n]) for n in toxicity.PREFIXES if len(w) >= n)]:
                h = int(textscan.Words(np.frombuffer(part.encode(), np.uint8), np.array([0, len(part)]), textscan.OTHERS).hashes()[0][0])
                out.add((h + n * 0x9E3779B1) % (1 << toxicity.SPACE_BITS))
        return out

    for r in got[:60]:
        eta = sum(float(weights[f]) for f in features(rows[r.doc_id][1]))
        assert abs(r.expected_severity - sum(1 / (1 + np.exp(t - eta)) for t in theta)) < 1e-4


def test_upper_tail_is_exact():
    from math import comb

    a, b = np.array([0, 1, 5, 5, 9]), np.array([3, 2, 0, 7, 1])
    got = np.exp(toxicity.log_upper_tail(a, b, 11, 40))
    want = [sum(comb(11, i) * comb(40, x + y - i) for i in range(x, min(11, x + y) + 1)) / comb(51, x + y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert np.allclose(got, want, rtol=1e-9)


def test_ordinal_fit_orders_thresholds():
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(5) < 0.4) for _ in range(500)]
    grades = np.array([min(2, int((r < 2).sum())) for r in rows])
    w, theta = toxicity.fit_ordinal(rows, grades, 5)
    assert theta[0] < theta[1] and w[:2].min() > w[2:].max()


@pytest.mark.parametrize("own", [3, 12, 30])
def test_near_pages_of_one_template(spark, own, monkeypatch):
    """Many pages share a template: with few own words they are linked, with more not; either way as by brute force, and by groups of rare shingles."""
    monkeypatch.setattr(neardup, "MOST_SETS", 8)
    monkeypatch.setattr(neardup, "CHUNK", 9)
    rnd = random.Random(own)
    template = [f"t{rnd.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(60):
        words = template + [f"o{rnd.randrange(10**9)}" for _ in range(own)]
        if i % 7 == 0 and rows:  # some near copies among them
            words = rows[-1][1].split()[:-1] + ["z"]
        rows.append((i, " ".join(words)))
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {tuple(r) for r in got.collect()} == near_brute(rows)
    assert own < 30 or 60 > got.where("kept").count() > 30
