"""Driver queries: the evidence operators on the driver's tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import once
from siftline.functions import text as tx
from siftline.functions import urls as ur
from siftline.functions.transactions import KEYWORDS, looks_like_alert
from siftline.operators.redact import redact_text
from siftline.plans import cases
from siftline.sources.raw import upsert


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.get(ur.normalize_urls(F.array("url")), F.lit(0)).alias("u"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _infos(spark, sf_dir).select("page_id", F.get(ur.reputations(F.array("u")), F.lit(0)).alias("r"))


def url_normalize(spark, sf_dir):
    names = ["canonical", "scheme", "host", "registered_domain", "tld", "subdomain_depth", "path", "is_ip_host", "uses_https"]
    return _infos(spark, sf_dir).select("page_id", *[F.col(f"u.{n}").alias(n) for n in names], F.size("u.query_params").alias("n_params"))


def url_reputation(spark, sf_dir):
    return _scored(spark, sf_dir).select("page_id", F.col("r.score").alias("score"), F.col("r.verdict").alias("verdict"), F.array_join(F.transform("r.signals", lambda s: s["name"]), ",").alias("signals"))


def url_verdict_counts(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy(F.col("r.verdict").alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.sum("r.score").alias("total_score"))


def url_signals(spark, sf_dir):
    return _scored(spark, sf_dir).select(F.explode("r.signals").alias("s")).groupBy(F.col("s.name").alias("signal")).agg(F.count(F.lit(1)).alias("n"), F.sum("s.weight").alias("weight"))


def url_listed(spark, sf_dir):
    """Reputation after a list of domains joined on host and domain."""
    lists = spark.createDataFrame([("example.org", "block"), ("example.net", "allow"), ("m.example.org", "allow")], "domain string, kind string")
    rows = _infos(spark, sf_dir).select("page_id", F.col("u.host").alias("host"), F.get(ur.reputations(F.array("u")), F.lit(0)).alias("r"))
    return ur.with_lists(rows, "r", "host", lists).groupBy(F.col("r.verdict").alias("verdict"), F.size("r.sources").alias("n_sources")).agg(F.count(F.lit(1)).alias("n"))


def doc_entity_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", once(tx.refang(F.col("text")), lambda t: F.struct(F.size(tx.emails(t)).alias("e"), F.size(tx.amounts(t)).alias("a"))).alias("x"))
    return docs.select("doc_id", F.col("x.e").alias("n_emails"), F.col("x.a").alias("n_amounts")).filter("n_emails > 0 OR n_amounts > 0")


def doc_email_list(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").filter(F.col("text").contains("@"))
    return docs.select("doc_id", F.explode(tx.emails(F.col("text"))).alias("email"))


def doc_types(spark, sf_dir):
    """What ingestion takes documents for: a sum of money and two words of banking make a payment alert."""
    docs = _table(spark, sf_dir, "documents")
    words = F.size(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(KEYWORDS), F.lit(1)), F.lower)))
    kind = F.when((words >= 2) & (F.size(tx.amounts(tx.refang(F.col("text")))) > 0), "transaction").otherwise("message")
    return docs.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def luhn_cards(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").filter(F.col("text").rlike("[0-9]{16}"))
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b([0-9]{16})\b"), F.lit(1))).alias("digits"))
    return found.select("doc_id", "digits", F.call_function("luhn_check", F.col("digits")).alias("valid"))


def doc_hash_dedupe(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy(tx.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


def doc_redacted(spark, sf_dir):
    """E-mail addresses of all documents replaced."""
    return _table(spark, sf_dir, "documents").select("doc_id", redact_text(F.col("text"), ["email"]).alias("text"))


def _made_url():
    """Addresses made from a page's number, so that each signal occurs."""
    n = F.col("page_id")
    return (
        F.when(n % 6 == 0, F.format_string("http://sbi-login%d.top/verify", n))
        .when(n % 6 == 1, F.format_string("http://a.b.c.d.x%d99999.xyz/account", n))
        .when(n % 6 == 2, F.concat(F.format_string("https://my-free-prize-win%d.click/otp?x=", n), F.repeat(F.lit("a"), F.lit(100))))
        .when(n % 6 == 3, F.lit(f"http://www.{LEGITIMATE}/login"))
        .when(n % 6 == 4, F.format_string("https://paytm.kyc-update.example%d.com/", n))
        .otherwise(F.col("url"))
    )


#: A brand's own domain.
LEGITIMATE = sorted(d for ds in ur.BRANDS.values() for d in ds)[0]


def url_made_signals(spark, sf_dir):
    """Reputation of the made addresses: score, verdict and every signal."""
    u = _table(spark, sf_dir, "pages").select("page_id", F.get(ur.normalize_urls(F.array(_made_url())), F.lit(0)).alias("u"))
    r = u.select("page_id", F.get(ur.reputations(F.array("u")), F.lit(0)).alias("r"))
    return r.select("page_id", F.col("r.score").alias("score"), F.col("r.verdict").alias("verdict"), F.array_join(F.transform("r.signals", lambda s: s["name"]), ",").alias("signals"))


def _made_alert():
    """Bank alerts, defanged links and plain texts made from an order."""
    k, cents = F.col("o_orderkey"), F.format_number(F.col("o_orderkey") * 137 % 900000 + F.lit(100), 0)
    return (
        F.when(k % 4 == 0, F.concat(F.lit("Rs. "), cents, F.lit(".50 debited from A/c XX1234 via UPI")))
        .when(k % 4 == 1, F.concat(F.lit("see hxxps://bad["), F.lit(".]top/"), k.cast("string"), F.lit(" or mail Help"), k.cast("string"), F.lit("@Shop.Example.org")))
        .when(k % 4 == 2, F.concat(F.lit("send "), cents, F.lit(" rupees and $5 to pay"), k.cast("string"), F.lit("@okaxis")))
        .otherwise(F.concat(F.lit("order "), k.cast("string")))
    )


def made_entities(spark, sf_dir):
    """What is found in the made texts, and what ingestion takes them for."""
    t = _table(spark, sf_dir, "orders").select("o_orderkey", tx.refang(_made_alert()).alias("t"))
    words = F.size(F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(KEYWORDS), F.lit(1)), F.lower)))
    alert = once(F.col("t"), looks_like_alert)
    return t.select("o_orderkey", F.array_join(F.transform(tx.amounts(F.col("t")), lambda a: F.concat_ws(" ", a["currency"], F.format_number(a["value"], 2))), ";").alias("amounts"), F.array_join(tx.urls(F.col("t")), ";").alias("urls"), F.array_join(tx.emails(F.col("t")), ";").alias("emails"), F.array_join(tx.upi_ids(F.col("t")), ";").alias("upi_ids"), words.alias("words"), alert.alias("alert"))


def store_upsert(spark, sf_dir):
    """The newest record of each key, at the place of the first one."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").cast("int").alias("rec_ord"), F.col("event_type").alias("evidence_id"), "value")
    merged = upsert(e.filter("rec_ord % 2 = 0"), e.filter("rec_ord % 2 = 1"))
    return merged.groupBy("case_id").agg(F.count(F.lit(1)).alias("records"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double").alias("value"), F.min("rec_ord").alias("first_place"))


QUERIES = {f.__name__: f for f in (
    url_normalize, url_reputation, url_verdict_counts, url_signals, url_listed, url_made_signals, doc_entity_counts, doc_email_list, doc_types, luhn_cards, doc_hash_dedupe, doc_redacted, made_entities, store_upsert,
)} | cases.QUERIES


def _array(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_URL_SQL = f"""
WITH split AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
         CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END AS path,
         list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^({"|".join(ur.TRACKING)})')) AS q
  FROM pages
), norm AS (
  SELECT *, scheme || '://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical, string_split(host, '.') AS labels,
         regexp_matches(host, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') AS is_ip
  FROM split
), dom AS (
  SELECT *, CASE WHEN len(labels) >= 3 AND list_contains({_array(ur.MULTI_SUFFIXES)}, array_to_string(labels[-2:], '.')) THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain,
         regexp_replace(host, '[^a-z0-9]', '', 'g') AS compact
  FROM norm
), sig AS (
  SELECT *, string_split(domain, '.')[1] AS name, len(list_filter({_array(ur.PHISHING_WORDS)}, lambda w: contains(lower(host || path), w))) AS hits,
         ({" OR ".join(f"(contains(compact, '{b}') AND NOT (" + " OR ".join(f"host = '{d}' OR host LIKE '%.{d}'" for d in ds) + "))" for b, ds in ur.BRANDS.items())}) AS brand
  FROM dom
), signals AS (
  SELECT *, list_filter([
    CASE WHEN scheme <> 'https' THEN {{'name': 'no_https', 'weight': 10}} END,
    CASE WHEN list_contains({_array(ur.SUSPICIOUS_TLDS)}, labels[-1]) THEN {{'name': 'suspicious_tld', 'weight': 20}} END,
    CASE WHEN length(name) - length(replace(name, '-', '')) >= 2 THEN {{'name': 'many_hyphens', 'weight': 10}} END,
    CASE WHEN length(regexp_replace(name, '[^0-9]', '', 'g')) >= 4 THEN {{'name': 'digit_heavy_domain', 'weight': 10}} END,
    CASE WHEN len(labels) - 2 >= 3 THEN {{'name': 'deep_subdomains', 'weight': 15}} END,
    CASE WHEN length(canonical) > 100 THEN {{'name': 'very_long_url', 'weight': 5}} END,
    CASE WHEN brand THEN {{'name': 'brand_impersonation', 'weight': 45}} END,
    CASE WHEN hits > 0 THEN {{'name': 'phishing_keywords', 'weight': CAST(least(8 * hits, 24) AS INTEGER)}} END,
    CASE WHEN list_contains({_array(sorted({d for ds in ur.BRANDS.values() for d in ds}))}, domain) THEN {{'name': 'known_legitimate_domain', 'weight': -40}} END
  ], lambda s: s IS NOT NULL) AS found FROM sig
), scored AS (
  SELECT *, CAST(greatest(0, least(100, coalesce(list_sum(list_transform(found, lambda s: s.weight)), 0))) AS INTEGER) AS score FROM signals
), judged AS (
  SELECT *, CASE WHEN score >= {ur.MALICIOUS} THEN 'malicious' WHEN score >= {ur.SUSPICIOUS} THEN 'suspicious' ELSE 'benign' END AS verdict FROM scored
)
"""
_AMOUNT_SQL = r"(?i)(?:₹|rs\.?|inr|\$|usd|€|eur)\s*(?:\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)|(?:\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)\s*(?:rs\.?|inr|rupees|usd|dollars)\b"
_EMAIL_SQL = r"(?i)[\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}"
_MADE_URL_SQL = f"""(SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'http://sbi-login' || page_id || '.top/verify' WHEN 1 THEN 'http://a.b.c.d.x' || page_id || '99999.xyz/account' WHEN 2 THEN 'https://my-free-prize-win' || page_id || '.click/otp?x=' || repeat('a', 100)
  WHEN 3 THEN 'http://www.{LEGITIMATE}/login' WHEN 4 THEN 'https://paytm.kyc-update.example' || page_id || '.com/' ELSE url END AS url FROM pages)"""
_CENTS = "format('{:,}', o_orderkey * 137 % 900000 + 100)"

ORACLES = {
    "url_normalize": _URL_SQL + "SELECT page_id, canonical, scheme, host, array_to_string(labels[-2:], '.') AS registered_domain, labels[-1] AS tld, CAST(greatest(len(labels) - 2, 0) AS INTEGER) AS subdomain_depth, path, is_ip AS is_ip_host, scheme = 'https' AS uses_https, CAST(len(list_distinct(list_transform(q, lambda p: string_split(p, '=')[1]))) AS INTEGER) AS n_params FROM norm",
    "url_reputation": _URL_SQL + "SELECT page_id, score, verdict, array_to_string(list_transform(found, lambda s: s.name), ',') AS signals FROM judged",
    "url_verdict_counts": _URL_SQL + "SELECT verdict, count(*) AS n, CAST(sum(score) AS BIGINT) AS total_score FROM judged GROUP BY verdict",
    "url_signals": _URL_SQL + "SELECT s.name AS signal, count(*) AS n, CAST(sum(s.weight) AS BIGINT) AS weight FROM (SELECT unnest(found) AS s FROM judged) GROUP BY s.name",
    "url_listed": _URL_SQL + """, hit AS (
      SELECT *, CASE WHEN host IN ('example.org') OR domain IN ('example.org') THEN 'block' WHEN host IN ('example.net', 'm.example.org') OR domain IN ('example.net', 'm.example.org') THEN 'allow' END AS kind FROM judged
    ), again AS (
      SELECT kind, CASE kind WHEN 'allow' THEN 0 WHEN 'block' THEN greatest(0, least(100, coalesce(list_sum(list_transform(found, lambda s: s.weight)), 0) + 100)) ELSE score END AS score FROM hit
    )
    SELECT CASE WHEN score >= 60 THEN 'malicious' WHEN score >= 25 THEN 'suspicious' ELSE 'benign' END AS verdict, CAST(CASE WHEN kind IS NULL THEN 1 ELSE 2 END AS INTEGER) AS n_sources, count(*) AS n FROM again GROUP BY 1, 2""",
    "doc_entity_counts": f"SELECT doc_id, CAST(len(list_distinct(list_transform(regexp_extract_all(text, '{_EMAIL_SQL}'), lambda x: lower(x)))) AS INTEGER) AS n_emails, CAST(len(regexp_extract_all(text, '{_AMOUNT_SQL}')) AS INTEGER) AS n_amounts FROM documents WHERE n_emails > 0 OR n_amounts > 0",
    "doc_email_list": f"SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{_EMAIL_SQL}'))) AS email FROM documents",
    "doc_types": f"SELECT CASE WHEN len(list_distinct(list_transform(regexp_extract_all(text, '{KEYWORDS.replace('(?iU)', '(?i)')}'), lambda x: lower(x)))) >= 2 AND len(regexp_extract_all(text, '{_AMOUNT_SQL}')) > 0 THEN 'transaction' ELSE 'message' END AS kind, count(*) AS n FROM documents GROUP BY 1",
    "luhn_cards": r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b([0-9]{16})\b', 1)) AS digits FROM documents)
      SELECT doc_id, digits, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CAST(digits[i] AS INTEGER) * 2 - CASE WHEN CAST(digits[i] AS INTEGER) > 4 THEN 9 ELSE 0 END ELSE CAST(digits[i] AS INTEGER) END)) % 10 = 0 AS valid FROM c""",
    "doc_hash_dedupe": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1",
    "url_made_signals": _URL_SQL.replace("FROM pages", f"FROM {_MADE_URL_SQL}") + "SELECT page_id, score, verdict, array_to_string(list_transform(found, lambda s: s.name), ',') AS signals FROM judged",
    "doc_redacted": r"SELECT doc_id, regexp_replace(text, '(?i)[\p{L}\p{N}_.+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}\b', '[REDACTED]', 'g') AS text FROM documents",
    "made_entities": f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'INR ' || {_CENTS} || '.50' WHEN 2 THEN 'INR ' || {_CENTS} || '.00;USD 5.00' ELSE '' END AS amounts, CASE WHEN o_orderkey % 4 = 1 THEN 'https://bad.top/' || o_orderkey ELSE '' END AS urls,
      CASE WHEN o_orderkey % 4 = 1 THEN 'help' || o_orderkey || '@shop.example.org' ELSE '' END AS emails, CASE WHEN o_orderkey % 4 = 2 THEN 'pay' || o_orderkey || '@okaxis' ELSE '' END AS upi_ids, CASE o_orderkey % 4 WHEN 0 THEN 3 ELSE 0 END AS words, o_orderkey % 4 = 0 AS alert FROM orders""",
    "store_upsert": "WITH b AS (SELECT user_id AS case_id, event_type AS k, CAST(event_id AS INTEGER) AS o, value, event_id % 2 AS g FROM events), m AS (SELECT *, max(CASE WHEN g = 0 THEN o END) OVER (PARTITION BY case_id) AS last_old FROM b), p AS (SELECT *, CASE WHEN g = 0 THEN o ELSE coalesce(last_old, -1) + 1 + o END AS place FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY case_id, k ORDER BY g DESC, o DESC) AS n, min(place) OVER (PARTITION BY case_id, k) AS first_place FROM p) SELECT case_id, count(*) AS records, CAST(round(sum(CAST(value AS DECIMAL(18, 4))), 2) AS DOUBLE) AS value, CAST(min(first_place) AS INTEGER) AS first_place FROM r WHERE n = 1 GROUP BY case_id",
} | cases.ORACLES
