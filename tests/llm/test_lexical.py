"""Ranked search against scores of every document, with small segments, blocks and bounds, nulls, ties and odd ids."""

import collections
import math
import random
import re

import pytest

from seqweft.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(i, at, collections.Counter(terms(t))) for at, (i, t) in enumerate(docs)]
    n_docs, total = sum(1 for *_, b in bags if b), sum(sum(b.values()) for *_, b in bags)
    df = collections.Counter(t for *_, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, at, bag in bags:
            m = 10 + 90 * sum(bag.values()) * n_docs // max(1, total)
            s = sum(weight[t] * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if t in bag)
            if s > 0:
                scored.append((-s, i is None, i or 0, at))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i, _) in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


def corpus(seed=2, n=400):
    rnd = random.Random(seed)
    words = [f"{rnd.choice('abcdéf')}{k}" for k in range(300)]
    pick = lambda size: [words[min(299, int(rnd.expovariate(0.03)))] for _ in range(size)]
    rows = [" ".join(pick(rnd.choice([1, 5, 30, 80]))) for _ in range(n)]
    items = [" ".join(pick(rnd.randint(1, 40))) for _ in range(25)]
    for text in items[:12]:
        for _ in range(rnd.randint(1, 12)):
            rows[rnd.randrange(n)] = rnd.choice(["{}", "{} x", "X-{}.", "{0} {0}"]).format(text)
    rows += [None, "", " .,; ", "Éa ÀB a_b A1", rows[3], rows[3], "a0 " * 5_000 + "a1", "nothing.else"]
    items += [None, "", "...", "A0", "a0 zzz", items[0], "zzz yyy", "É éa a_b"]
    return list(enumerate(rows)), list(enumerate(items))


@pytest.mark.parametrize("small", [False, True])
def test_ranks_and_scores(spark, small, monkeypatch):
    if small:  # many segments and blocks: the same rows
        for name, value in (("DOCUMENTS", 7), ("POSTINGS", 60), ("BLOCK", 4), ("SPREAD", 3)):
            monkeypatch.setattr(lexical, name, value)
    rows, items = corpus()
    docs = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, term string, key int").repartition(3)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, q int")
    for k in (10, 2):
        got = lexical.ranked_search(docs, asked, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
        assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, items, k)


def test_a_filter_that_lets_everything_pass(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BITS", 1)
    rows, items = corpus(5, 60)
    got = lexical.ranked_search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, items)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (5, "a b"), (5, "a b"), (2, "c c"), (None, "a"), (9, None)]
    items = [(None, "a"), (1, "a c"), (1, "a c")]
    got = lexical.ranked_search(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, items)
    named = lexical.ranked_search(spark.createDataFrame([("x", "a b"), ("y", "b")], "name string, body string"), spark.createDataFrame([("i", "b")], "name string, body string"), 10, "name", "name", "body")
    assert sorted((r.item_id, r.rank, r.doc_id) for r in named.collect()) == [("i", 1, "y"), ("i", 2, "x")]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked_search(docs, items).count() == 0
    assert lexical.ranked_search(items.withColumnRenamed("item_id", "doc_id"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert lexical.ranked_search(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).count() == 0
