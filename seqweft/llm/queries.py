"""The queries of the operators, with production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exactdedup, lexical, neardup, packing, periodic, pii, quality, substring, tokenfiles, toxicity, urlfilter


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of the URL query (fixed values of its contract): host and path, verdict.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], turns.schema)
    return chat.chat_digests(chat.format_chats(turns.unionByName(more)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.drop("rule_rejected")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), with_ids=False)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(_table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_tokens(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return files.lookup(files.places, name_col="name")


def _repeated(doc_id, n: int) -> tuple[int, int] | None:
    """The contract's rewriting: one document in ten repeats its words from a on with period p; none without an id."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g, a = h // 10, h // 10 % n
    return None if h % 10 else (a, 1 + (n - a) // (3 + g % 8))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(_table(spark, sf_dir, "documents"), repeat=_repeated)


QUERIES = {f.__name__: f for f in (op1_chat, op2_toxicity, op3_url_filter, op4_quality_rules, op5_pii, op6_packing, op7_bpe, op8_exact_dedup, op9_near_dedup, op10_substring_dedup, op11_ranked_search, op12_token_files, op13_periodic_runs)}

#: The strings of the chat template in the oracle: each row adds the marks around it, and breaks add one mark each.
SQL = {
    "op1_chat": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
          SELECT *, length(text) + length(regexp_replace(text, '[^␛]', '', 'g'))
                    + 2 * len(regexp_extract_all(text, '<\|(?:turn|text|more|end|endoftext|startoftext|im_start|im_end)\|>|</?s>|\[/?INST\]')) AS chars,
                 row_number() OVER o AS k, lag(role) OVER o IS DISTINCT FROM role AS opens
          FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars + CASE WHEN opens THEN length(role) + length('<|turn|><|text|><|end|>') ELSE length('<|more|>') END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op3_url_filter": r"""
        WITH p AS (
          SELECT page_id,
                 translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
          FROM pages),
        r(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        f AS (
          SELECT page_id, host, path, rhost || rpath AS rule, v,
                 row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
          FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE k = 1""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY t)""",
    "op11_ranked_search": r"""
        WITH t AS (
          SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY doc_id, term),
        d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
        c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
        f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
              FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), c),
        q AS (
          SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        s AS (
          SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
          FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 10""",
}
