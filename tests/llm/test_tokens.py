"""Chat formatting, URL filters, BPE and packing, and the pipeline, against libraries and brute force."""

import array
import collections
import hashlib
import os
import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seqweft.llm import bpe, chat, packing, pii, urlfilter

BYTE, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "a", "  a  b\n\n c <|endoftext|>  x's I'll don't", "日本語 テスト 123 ４５ é  x", "\x1c a\x1f  b", "a  b  ", " " * 50 + "x", " \n\t a",
    "Foo's <|endoftext|>Bar<|ENDOFTEXT|>  x., y.", "É é Straße ΟΔΟΣ ΣΑΣ İ", "a b c\x1cd \u0301e", "3.14, 1,000; _x_, e.g.. (ok).", "word" * 3000, "x y " * 4000, "a\u00a0 b\u2003c",
]


def test_byte_bpe_equals_library(spark):
    tok = Tokenizer.from_file(BYTE)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    for r in bpe.encode_decode(df, BYTE).collect():
        ids = tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == tok.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(array.array("I", ids).tobytes()).hexdigest()


def test_byte_bpe_fuzzed_with_small_caches(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 20)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 50)
    tok, mine, rnd = Tokenizer.from_file(BYTE), bpe.ByteBpe(BYTE), random.Random(1)
    for _ in range(40):
        texts = ["".join(rnd.choice("etaoin shrdlu'  ,.\n1é日") for _ in range(rnd.randint(0, 60))) for _ in range(10)]
        assert mine.encode_batch(texts) == [array.array("I", tok.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_word_bpe_equals_library():
    tok, mine = Tokenizer.from_file(WORDS), packing.WordBpe(WORDS)
    rnd = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice("EtaoIn shrdlu'  ,.\n1éÀ日") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}s" for c in range(1, 0x300)]  # each character that is split here, and some beyond
    texts += ["it's he'll I'd we've'd 's's ''s .'re!'t ''", "x" * 5000 + "!" * 3000, "a\u2003b\u2028c\u200bd", "“So — it’s” é’s", "<|endoftext|x <|startoftext|>y"]
    for t in texts:
        assert mine.encode(t) == array.array("I", tok.encode(t, add_special_tokens=False).ids).tobytes(), t


def check_places(rows, capacity):
    """Gapless sequences within the capacity; the number of them."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark):
    rnd = random.Random(3)
    texts = TEXTS + [" ".join(rnd.choice(["the", "cat", "sat", "mat"]) for _ in range(rnd.randint(1, 1500))) for _ in range(300)] + ["same words here"] * 50
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(4)
    rows = packing.pack_documents(df, WORDS, with_ids=True).collect()
    tok = Tokenizer.from_file(WORDS)
    got = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(array.array("I", r.ids).tobytes()) and r.length == len(r.ids) <= 2048
    for i, t in enumerate(texts):
        own = sorted(got[i], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert all(r.length == 2048 for r in own[:-1]) and [r.start for r in own] == [2048 * k for k in range(len(own))]
    total = sum(r.length for r in rows)
    assert check_places(rows, 2048) <= 1.05 * total / 2048 + 1
    assert packing.pack_documents(df.limit(0), WORDS).count() == 0


def fewest(lengths, capacity):
    """Best-fit decreasing."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= x]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_plan_is_never_worse_than_best_fit():
    rnd = random.Random(4)
    for trial in range(60):
        cap = rnd.choice([8, 10, 64, 256])
        h = {rnd.randint(1, cap): rnd.randint(1, 40) for _ in range(rnd.randint(0, 30))}
        places, n = packing.least_plan(dict(h), cap)
        rank = collections.Counter()
        fill = collections.defaultdict(list)
        for x, r, first, at, m in places.tolist():
            assert r == rank[x]
            rank[x] += m
            for i in range(m):
                fill[first + i].append((at, x))
        assert dict(rank) == h and len(fill) == n
        for v in fill.values():
            assert sum(x for _, x in v) <= cap and all(a[0] + a[1] == b[0] for a, b in zip(sorted(v), sorted(v)[1:], strict=False))
        best = fewest([x for x, c in h.items() for _ in range(c)], cap)
        assert n <= best, (trial, n, best)


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "user", "again <|turn|>x<|text|>"), (1, 2, "assistant", "yo"), (1, 3, "assistant", ""), (1, 3, "assistant", None), (1, 3, "assistant", "tie"),
    (2, 0, None, "␛1</s>[INST]<|more|>␛0"), (2, None, "assistant", "<|end|><|end|>␛"), (None, 5, "assistant", None), (3, 1, "as<|end|>t", "[/INST]\n <|turn|<|turn|>"),
]


def test_chats_read_back(spark):
    df = spark.createDataFrame([(*r, "x") for r in CHATS], "conv_id long, turn long, role string, text string, turns_ string").repartition(3)
    made = chat.format_chats(df)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    want = collections.defaultdict(list)
    for r in sorted(CHATS, key=order):
        want[r[0]].append((r[2] or "", r[3] or ""))
    back = {r.conv_id: [tuple(t) for t in r.t] for r in made.select("conv_id", chat.read_turns(made.formatted).alias("t")).collect()}
    assert back == want
    for r in made.collect():
        body = r.formatted
        for c in chat.CONTROL[4:]:
            assert c not in body
        assert body.count(chat.TURN) == body.count(chat.END)
    for r in chat.chat_digests(made).collect():
        own = want[r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss)) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


def judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for r, v in rules:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r), len(h), r, v))
    return host, path, max(fits)[2:] if fits else None


@pytest.mark.parametrize("digest", [urlfilter._digest, lambda b: len(b) % 3])
def test_urls(spark, digest):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("a.net/e", "allow")]
    urls = [None, "", "x", "http://", "http://EXAMPLE.com/en/", "https://www.Example.com/en/1?q#r", "a://b.example.com/en/x", "http://a.net/es/", "http://net/es/?", "http://xnet/es/", "s://example.com?u=/en/", "s://É.com/ü://x", "s://a..com/", "http://com"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for r in urlfilter.judge_urls(df, rules, digest=digest).collect():
        host, path, hit = judge(urls[r.page_id], rules)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, hit and hit[0], hit[1] if hit else "allow"), urls[r.page_id]
    assert {r.rule for r in urlfilter.judge_urls(df, [], digest=digest).collect()} == {None}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline as cp
    from test_text import near_brute, norm

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns, name
        now = {r.doc_id: r.text for r in kept.collect()}
        if name == "quality_rules":
            after_rules = now
        if name == "exact_dedup":
            first = {}
            for i in sorted(after_rules):
                first.setdefault(norm(after_rules[i]), i)
            assert set(now) == set(first.values())
            exact = now
        if name == "near_dedup":
            assert set(now) == {i for i, _, _, keep in near_brute(list(exact.items()), 80) if keep}
        if name == "personal_data":
            spans = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(near, "doc_id long, text string")).collect()}
            before = dict(near)
            for i, t in now.items():
                own = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans[i].split(",") if x))
                out, at = "", 0
                for a, b, k in own:
                    if b > at:
                        out += before[i][at : max(a, at)] + (f"<{k.upper()}>" if a >= at else "")
                        at = b
                assert t == out + before[i][at:]
            assert any(t != before[i] for i, t in now.items())
        near = list(now.items())
    rows = cp.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(now)
    check_places(rows, 2048)


def test_pipeline_edges(spark, tmp_path):
    """Null and repeated ids, null and empty texts, null columns; and an empty table."""
    import corpus_pipeline as cp

    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(200)]
    prose = lambda: " ".join(rnd.choice(words) for _ in range(60))
    one, two, three = prose(), prose(), prose()
    rows = [(None, one, "en", "s", 5), (None, one, None, None, None), (7, one, "en", "s", 5), (7, two, "en", "s", 5), (3, two + " x", "xx", None, None), (None, three, None, None, None), (4, None, None, None, None), (5, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, content in (("full", rows), ("empty", [])):
        at = tmp_path / name
        spark.createDataFrame(content, schema).write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([(7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    got = cp.run(spark, str(tmp_path / "full")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "7", "None"]
    check_places(got, 2048)
    assert cp.run(spark, str(tmp_path / "empty")).count() == 0
