"""Maximal runs against a quadratic search, on fuzzed words, repetitive texts, edges and the contract's rewriting."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from seqweft.llm import periodic, queries


def brute(words, shortest=12):
    """All runs by the definition: for each period the stretches of equal words that far apart, smallest periods only."""
    n, runs = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            part = words[i : i + length]
            if length >= 2 * q and not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                runs.append((i, length, q))
            i = j
    return sorted((r for r in runs if r[1] >= max(shortest, 2 * r[2])), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def cases():
    rnd = random.Random(3)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 200, ["a", "b"] * 6, ["a", "b"] * 5 + ["a"], fibonacci(150), fibonacci(89) * 2]
    for _ in range(300):
        letters = "ab" if rnd.random() < 0.5 else "abcdefgh"
        words = [rnd.choice(letters) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            part = words[-rnd.randint(1, 9) :] or ["x"]
            words += part * rnd.randint(1, 5) + [rnd.choice(letters) for _ in range(rnd.randint(0, 6))]
        out.append(words)
    return out


@pytest.mark.parametrize("shortest", [2, 12])
@pytest.mark.parametrize("step", [1 << 21, 5])
def test_runs_of_many_texts_at_once(shortest, step, monkeypatch):
    monkeypatch.setattr(periodic, "STEP", step)
    rows = cases()
    code = {}
    letters = np.array([code.setdefault((r, w), len(code)) for r, words in enumerate(rows) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum([len(w) for w in rows])])
    assert periodic.maximal_runs(letters, first, shortest) == [brute(w, shortest) for w in rows]


def test_suffix_tree_order_and_depths():
    rnd = random.Random(5)
    for n in (1, 2, 7, 60, 300):
        letters = np.array([rnd.randint(0, 2) for _ in range(n)], np.int64)
        order, place, depth = periodic.suffix_tree(letters)
        plain = letters.tolist()
        assert order.tolist() == sorted(range(n), key=lambda i: plain[i:])
        assert place[order].tolist() == list(range(n))
        for k in range(n - 1):
            a, b = plain[order[k] :], plain[order[k + 1] :]
            d = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert depth[k] == d


def expected(doc_id, text, repeat):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if repeat and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(listed), sha(kept), kept)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_rows_against_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([" ", "\n", " \t"]).join(w)) for i, w in enumerate(cases())]
    rows += [(None, "a b " * 20), (None, None), (7, rows[7][1]), (10_000, None), (10_001, " \n "), (10_002, "é x " * 15), (10_003, " ".join(f"w{k % 700}" for k in range(2_000)))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, runs string").repartition(3)
    for repeat in (None, queries._repeated):
        got = periodic.periodic_runs(df, repeat=repeat, with_text=True)
        have = [tuple(r[c] for c in [*COLUMNS, "collapsed"]) for r in got.collect()]
        assert sorted(map(str, have)) == sorted(str(expected(i, t, repeat)) for i, t in rows)
    runs = {r.doc_id: r.runs for r in periodic.periodic_runs(df, with_text=True).collect()}
    assert [tuple(x) for x in runs[10_003]] == [(0, 2_000, 700)]


def test_empty_table_other_ids_and_long_repetitions(spark):
    none = periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert none.columns == COLUMNS and none.count() == 0
    long = "same " * 200_000
    df = spark.createDataFrame([("k", long), ("l", "a b c")], "name string, body string")
    got = {r.doc_id: r for r in periodic.periodic_runs(df, "name", "body").collect()}
    assert (got["k"].start, got["k"].length, got["k"].period, got["k"].n_runs) == (0, 200_000, 1, 1)
    assert got["k"].collapsed_sha256 == hashlib.sha256(b"same").hexdigest() and got["l"].n_runs == 0 and got["l"].start is None
