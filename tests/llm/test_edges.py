"""Empty tables, repeated rows, clashing column names and ids of other types, for operators whose other tests lack them."""

import collections

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seqweft.llm import bpe, chat, common, exactdedup, packing, pii, quality, substring, toxicity, urlfilter

BYTE, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LABELS = "doc_id long, quality int, toxic int"
ROWS = [(1, "one two three a@b.de 1.2.3.4", "en"), (2, None, None), (None, "a <|endoftext|> b", "xx"), (3, "", "de")]


def times(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS)
    pages = spark.createDataFrame([], "page_id long, url string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (
        urlfilter.judge_urls(pages, [("a/", "block")]), quality.quality_verdicts(docs, labels), quality.filter_quality(docs, labels), bpe.encode_decode(docs, BYTE),
        exactdedup.exact_groups(docs), exactdedup.exact_dedup(docs), packing.pack_documents(docs, WORDS), pii.find_personal_data(docs), chat.chat_digests(chat.format_chats(turns)),
        toxicity.toxicity(docs, labels), substring.repeated_passages(docs),
    ):
        assert df.count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    """Operators that judge rows alone give a repeated row the same result as often as it stands there."""
    one = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    one = one.select("*", *(F.lit(c).alias(c) for c in ("key", "t", "f", "h", "n_words", "grade", "ids", "spans", "found", "pii_key_", "quality_", "length", "piece")))
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], LABELS)
    for run, columns in (
        (lambda df: bpe.encode_decode(df, BYTE), ("doc_id", "n_tokens", "ids_sha256")),
        (lambda df: quality.quality_verdicts(df, labels), ("doc_id", "n_words", "word_chars", "kept")),
        (lambda df: pii.find_personal_data(df), ("doc_id", "n_email", "n_ip", "spans")),
        (lambda df: packing.pack_documents(df, WORDS), ("doc_id", "piece", "length", "ids_crc32")),
        (lambda df: toxicity.toxicity(df, labels), ("doc_id", "grade", "toxic")),
    ):
        once, twice = times(run(one), *columns), times(run(one.union(one)), *columns)
        assert len(once) == 4 and twice == {k: 2 * n for k, n in once.items()}
    assert pii.redact(one).columns == quality.filter_quality(one, labels).columns == one.columns
    assert times(pii.redact(one), "text")[("one two three <EMAIL> <IP>",)] == 1


def test_string_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([("a", text), ("b", text + " x"), ("c", "z")], "doc_id string, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring.repeated_passages(df).collect()) == [("a", 40), ("b", 40), ("c", 0)]
    assert {r.doc_id for r in packing.pack_documents(df, WORDS).collect()} == {"a", "b", "c"} == {r.doc_id for r in pii.find_personal_data(df).collect()}


def test_a_cluster_needs_a_shared_folder():
    class Nothing:
        def __init__(self, master):
            self.conf, self.sparkContext, self.master = self, self, master

        def get(self, key, default):
            return default

        def set(self, key, value):
            self.made = value

    for master in ("spark://h:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(Nothing(master))
    assert common.shared_dir(Nothing("local[4]"))
