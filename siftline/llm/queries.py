"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bpe, flac, langid, linecrf, mixing, neardup, pii, sentspans, toxicity, urllm
from siftline.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linecrf.judge(docs, linecrf.train(docs, table(spark, sf_dir, "labels"))).drop("text")


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as 8-bit samples in a FLAC file, read back by the decoder; null and empty texts are one block of padding."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    padded = F.greatest(F.ceil(n / flac.BLOCK), F.lit(1)).cast("int") * flac.BLOCK
    fill = F.to_binary(F.repeat(F.lit("FF"), padded - n), F.lit("hex"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(raw, fill).alias("payload"), n.cast("long").alias("n_bytes"))
    read = flac.decode(flac.store_bytes(docs, "payload").drop("payload"))
    payload = F.to_binary(F.array_join(F.transform("blocks", lambda b: F.hex(b["pcm"])), ""), F.lit("hex"))
    read = read.select("doc_id", "n_bytes", "media", "feature", payload.alias("payload"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


#: Host and path prefix, and what is said of them; the longest that fits wins.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op3_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urllm.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op4_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.judge(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).drop("text")


def op5_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN))


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentspans.remove_repeats(docs, short_words=sentspans.SHORT_WORDS)


def op10_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_line_crf": op1_line_crf,
    "op2_flac": op2_flac,
    "op3_url_models": op3_url_models,
    "op4_classifier_chain": op4_classifier_chain,
    "op5_minhash_join": op5_minhash_join,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_disclosure": op7_disclosure,
    "op8_poisson_mix": op8_poisson_mix,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_string_kernel": op10_string_kernel,
}

_OP8_SQL = f"""
WITH docs AS (
  SELECT *, coalesce(source, '') AS src, source IS NOT NULL AS has,
         coalesce(CAST(doc_id AS VARCHAR), 'text' || md5(coalesce(text, ''))) AS ident
  FROM documents
), sizes AS (
  SELECT src, has, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM docs GROUP BY src, has
), rated AS (
  SELECT src, has,
         CASE WHEN chars > 0 THEN pow(chars, {mixing.TEMPERATURE}) / (SELECT sum(pow(chars, {mixing.TEMPERATURE})) FROM sizes)
              * (SELECT sum(chars) FROM sizes) / chars ELSE 1.0 END AS rate
  FROM sizes
), parts AS (
  SELECT src, has, CAST(greatest(ceil(rate / {mixing.MAX_RATE}), 1) AS BIGINT) AS n_parts, rate / greatest(ceil(rate / {mixing.MAX_RATE}), 1) AS r
  FROM rated
), pmf AS (
  SELECT src, has, n_parts, k, exp(-r + k * ln(r) - lgamma(k + 1.0)) AS p
  FROM (SELECT *, unnest(range(0, CAST(ceil(r + 12 * sqrt(r) + 16) AS BIGINT) + 1)) AS k FROM parts)
), cdf AS (
  SELECT src, has, n_parts, k, sum(p) OVER (PARTITION BY src, has ORDER BY k) AS c FROM pmf
), draws AS (
  SELECT DISTINCT ident, src, has, i,
         CAST(('0x' || substr(md5('{mixing.SEED}:' || CAST(i AS VARCHAR) || ':' || ident), 1, 13)) AS BIGINT) / pow(2.0, 52) AS u
  FROM (SELECT ident, d.src, d.has, unnest(range(1, n_parts + 1)) AS i FROM docs d JOIN parts USING (src, has))
), counted AS (
  SELECT ident, d.src, d.has, CAST(count(*) AS INTEGER) AS n_copies
  FROM draws d JOIN cdf USING (src, has) WHERE cdf.c <= d.u GROUP BY ident, d.src, d.has
), copies AS (
  SELECT doc_id, text, lang, source, n_chars, n_copies, unnest(range(0, n_copies)) AS replica
  FROM docs JOIN counted USING (ident, src, has)
)
SELECT doc_id, text, lang, source, n_chars, n_copies, CAST(replica AS INTEGER) AS replica FROM copies
"""

ORACLES: dict[str, str] = {"op8_poisson_mix": _OP8_SQL}
