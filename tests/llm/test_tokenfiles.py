"""Token files against the library, the perfect hash against its promise, keyed access, odd ids, lost attempts."""

import os
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqweft.llm import tokenfiles

BYTE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "Hello  world\n\n x", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "x\x1cy z", "line\x85next", "tab\t\t end ", "日本語 text 語 and  more",
    "emoji 😀😀 ok", "¹²³ ½ ǅ Ω мир  ʰ x", "don't we'll I'M", "a" * 3_000, "word " * 4_000, "é" * 50, " \xa0 x\xa0\xa0y", "᠎ x", "x  y z", "\r\n\r\n a\r",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BYTE)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_coder_gives_the_librarys_ids(library):
    coder = tokenfiles.byte_coder(BYTE)
    rnd = random.Random(4)
    letters = ["a", "B", "é", " ", "  ", "\n", "7", "²", ".", "'s", "_", "ß", "日", "я", " ", " ", "<|endoftext|>", "\x1d", "\x85", "😀", "the", "ing", "̀", "\x00", "ɏ", "ɐ"]
    fuzzed = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 30))) for _ in range(6_000)]
    for text in [*(t or "" for t in TEXTS), *fuzzed]:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library(text), repr(text)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1_000, 20_000])
def test_perfect_hash_is_minimal_and_knows_strangers(n):
    rnd = np.random.default_rng(n)
    keys = pa.array([x.tobytes() for x in rnd.bytes(16 * (n + 1)) and rnd.integers(0, 256, (n, 16), np.uint8)], pa.binary())
    slots = np.arange(3 * n).reshape(n, 3)
    made = tokenfiles.Bucket.unpack(tokenfiles.Bucket.build(keys, slots).pack())
    a, b = tokenfiles._halves(keys)
    assert sorted(made.hashed.find(a, b).tolist()) == list(range(n))
    known, slot = made.find(keys)
    assert known.all() and (slot[: len(keys)] == slots).all()
    other = pa.array([x.tobytes() for x in rnd.integers(0, 256, (2_000, 16), np.uint8)], pa.binary())
    assert not made.find(other)[0].any()
    if n:
        with pytest.raises(ValueError, match="128"):
            tokenfiles.Bucket.build(pa.concat_arrays([keys, keys.slice(0, 1)]), np.zeros((n + 1, 3), np.int64))


def expected(rows, library):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*library(text), 2]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize(("shard", "keys", "span", "width"), [(16 << 20, 1_000, 16 << 20, 2), (40, 3, 64, 2), (40, 3, 64, 4)])
def test_written_files_read_back(spark, library, monkeypatch, shard, keys, span, width):
    for name, value in (("SHARD", shard), ("KEYS", keys), ("SPAN", span)):
        monkeypatch.setattr(tokenfiles, name, value)
    monkeypatch.setattr(tokenfiles.byte_coder(BYTE), "largest", 50_256 if width == 2 else 70_000)
    rows = [(7 * i % 101 - 20, t) for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, shard int, name string").repartition(3)
    files = tokenfiles.write_tokens(docs, BYTE)
    got = files.lookup(files.places, name_col="name", with_ids=True).collect()
    want = expected(rows, library)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    text = dict(rows)
    assert all(r.ids == [*library(text[r.doc_id]), 2] for r in got)
    # the raw payload is all ids in ascending order of documents
    raw = b"".join(open(f"{files.folder}/{r.file}", "rb").read() for r in files.shards.orderBy("shard").collect())
    assert raw == b"".join(struct.pack("<H" if width == 2 else "<I", x) for i, _ in sorted(rows) for x in [*library(text[i]), 2])
    if shard == 40:
        assert files.shards.count() > 5 and files.index.count() > 5
    # keyed access: some keys, one of them often, and keys that are not there
    ask = spark.createDataFrame([(-20,), (5_000,), (-20,), (1,), (None,)], "doc_id long")
    some = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in files.lookup(ask).collect()}
    by_id = {w[0]: w for w in want}
    assert some == {by_id[-20], by_id.get(1, (1, None, None, None)), (5_000, None, None, None), (None, None, None, None)}
    assert files.get(-20) == [*library(text[-20]), 2] and files.get(5_000) is None
    files.discard()
    assert not os.path.exists(files.folder)


def test_null_repeated_and_string_ids(spark, library):
    rows = [(None, "a b"), (5, "one"), (5, "one"), (2, None), (None, "z")]
    files = tokenfiles.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), BYTE)
    got = files.lookup(files.places, name_col="name").collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), *x) for i, *x in expected(rows, library))
    named = tokenfiles.write_tokens(spark.createDataFrame([("b", "x"), ("a", "y z"), ("", None)], "id string, body string"), BYTE, id_col="id", text_col="body")
    assert [(r.doc_id, r.start) for r in named.lookup(named.places).orderBy("start").collect()] == [("", 0), ("a", 1), ("b", 4)] and named.get("a") == [*library("y z"), 2]


def test_empty_table_and_files_of_lost_attempts(spark, tmp_path):
    files = tokenfiles.write_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTE)
    assert files.lookup(files.places, name_col="name").count() == 0 and files.get(3) is None
    stale = tmp_path / "ids-0-0-old"
    stale.write_bytes(b"left by an attempt that was lost")
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    files = tokenfiles.write_tokens(docs, BYTE, folder=str(tmp_path))
    assert not stale.exists() and files.lookup(docs).where("ids_crc32 is null").count() == 0
    os.truncate(next(tmp_path.glob("ids-*")), 4)
    with pytest.raises(Exception, match="ends before"):
        files.lookup(docs).collect()
