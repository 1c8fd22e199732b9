"""Cases made from the events table: messages, links and payments that make every step of M1 to M4 and M6 fire, with SQL for the results.

A user is a case. Errors are messages that ask for money, signups bait without a sender, views harmless
messages, clicks links, purchases payment records; some payments are told twice, and differ. What each says
follows from its number, so that SQL can say what has to be found. One user in ten has no payments. Records, timeline and issues are settled
once for each session and folder, and used by all queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.checks import check
from siftline.operators.extract import extract
from siftline.operators.ingest import ingest
from siftline.operators.report import attempt_log, evidence_table, sections, unique_losses
from siftline.operators.timeline import build_timeline
from siftline.storage import settle

_TIME = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
_PAYEE = "CASE k % 3 WHEN 0 THEN concat('scam', user_id % 7, '@ybl') WHEN 1 THEN concat('shop', k % 13, '@okaxis') END"
#: Raw rows of the first telling, and of the second one of some payments.
_FIRST = f"""SELECT concat('u', user_id) AS case_id, CAST(k AS INT) AS rec_ord, 'events' AS source,
  CASE event_type WHEN 'error' THEN concat('Your KYC is pending. Pay Rs ', 100 * (1 + k % 5), ' to scam', user_id % 7, '@ybl now') WHEN 'signup' THEN 'You won a lottery prize, act immediately'
    WHEN 'view' THEN 'See you at lunch' WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'http://sbi-kyc.top/verify' ELSE 'https://example.com/a' END END AS text,
  CAST(NULL AS BINARY) AS bytes,
  CASE WHEN event_type = 'purchase' THEN to_json(named_struct('txn_id', CASE WHEN k % 4 <> 1 THEN concat('TXN', lpad(CAST(k AS STRING), 8, '0')) END, 'amount', CASE WHEN k % 17 <> 0 THEN CAST(100 * (1 + k % 7) AS STRING) END,
    'to', {_PAYEE}, 'from', 'me@okaxis', 'date', CASE WHEN k % 13 <> 0 THEN CASE WHEN k % 6 = 0 THEN date_format(ts, 'yyyy-MM-dd') ELSE {_TIME} END END,
    'currency', CASE WHEN k % 10 = 3 THEN 'USD' END, 'status', CASE WHEN k % 5 = 0 THEN 'FAILED' ELSE 'SUCCESS' END)) END AS json,
  CASE event_type WHEN 'purchase' THEN 'transaction' WHEN 'click' THEN 'url' ELSE 'message' END AS forced_type,
  map_filter(map('sender', CASE event_type WHEN 'error' THEN concat('Agent ', k % 3, ' <+9198765', lpad(CAST(user_id % 1000 * 10 + k % 2 AS STRING), 5, '0'), '>') WHEN 'view' THEN 'Asha' END,
    'timestamp', CASE WHEN event_type <> 'purchase' AND k % 11 <> 0 THEN {_TIME} END), (a, b) -> b IS NOT NULL) AS metadata
FROM {{e}}"""
_SECOND = f"""SELECT concat('u', user_id) AS case_id, CAST(10000000 + k AS INT) AS rec_ord, 'copies' AS source, CAST(NULL AS STRING) AS text, CAST(NULL AS BINARY) AS bytes,
  to_json(named_struct('txn_id', concat('TXN', lpad(CAST(k AS STRING), 8, '0')), 'amount', CAST(100 * (1 + k % 7) + CASE WHEN k % 3 = 1 THEN 50 ELSE 0 END AS STRING),
    'to', CASE WHEN k % 2 = 0 THEN {_PAYEE} ELSE 'other@ybl' END, 'from', CASE WHEN k % 9 = 0 THEN concat('scam', user_id % 7, '@ybl') WHEN k % 5 = 1 THEN 'me2@okaxis' ELSE 'me@okaxis' END,
    'date', date_format(ts + CASE WHEN k % 4 = 0 THEN INTERVAL 2 HOURS ELSE INTERVAL 0 HOURS END, "yyyy-MM-dd'T'HH:mm:ss"), 'currency', CASE WHEN k % 20 = 3 THEN 'EUR' END,
    'direction', CASE WHEN k % 9 = 0 THEN 'credit' END, 'status', CASE WHEN k % 8 = 0 THEN 'FAILED' ELSE 'SUCCESS' END)) AS json,
  'transaction' AS forced_type, CAST(map() AS MAP<STRING, STRING>) AS metadata
FROM {{e}} WHERE event_type = 'purchase' AND k % 4 <> 1 AND k % 7 < 3"""

_settled: dict[tuple[str, str], tuple[DataFrame, ...]] = {}


def _case_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Records, events, case summaries, issues and issue summaries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _settled:
        e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_id", "k")
        e = e.withColumn("event_type", F.when((F.col("user_id") % 10 == 9) & (F.col("event_type") == "purchase"), "view").otherwise(F.col("event_type")))
        raw = spark.sql(_FIRST, e=e).unionByName(spark.sql(_SECOND, e=e))
        records = settle(extract(settle(ingest(raw))))
        events, summary = (settle(df) for df in build_timeline(records))
        issues, counts = (settle(df) for df in check(events))
        _settled[key] = records, events, summary, issues, counts
    return _settled[key]


def scam_timeline(spark, sf_dir):
    events = _case_tables(spark, sf_dir)[1]
    return events.select("case_id", "sequence", "event_type", "stage", "severity", "time_precision", "since_previous", "title", F.size("linked_evidence").alias("links"), F.array_join("indicators", ",").alias("indicators"))


def scam_summary(spark, sf_dir):
    s = _case_tables(spark, sf_dir)[2]
    loss = lambda c: F.try_element_at("total_loss", F.lit(c))
    return s.select("case_id", "evidence_count", "event_count", "undated_event_count", "duration", "attack_chain", F.array_join("stages_observed", ",").alias("stages"), "fraudulent_payment_count", loss("INR").alias("inr"), loss("USD").alias("usd"), "time_to_first_loss", F.array_join("suspect_identifiers", ",").alias("suspects"), "highest_severity")


def scam_issues(spark, sf_dir):
    issues = _case_tables(spark, sf_dir)[3]
    return issues.select("case_id", "issue_id", "category", "issue_type", "severity", F.array_join("events", ",").alias("events"), F.size("evidence_ids").alias("evidence"))


def scam_issue_counts(spark, sf_dir):
    s = _case_tables(spark, sf_dir)[4]
    return s.select("case_id", "events_checked", "issue_count", "highest_severity", *[s.by_category[c].alias(c) for c in ("contradiction", "gap", "duplicate")], *[s.by_severity[c].alias(c) for c in ("high", "medium", "low")])


def scam_attempts(spark, sf_dir):
    return attempt_log(_case_tables(spark, sf_dir)[1]).select("case_id", "entry", "sequence", "event_type", "action", "outcome", "channel", "counterparty", "amount", "currency", "transaction_id")


def scam_losses(spark, sf_dir):
    """Payments told in several documents count once."""
    losses = unique_losses(attempt_log(_case_tables(spark, sf_dir)[1]))
    return losses.select("case_id", "payment_count", *[F.try_element_at("unique_loss", F.lit(c)).alias(c.lower()) for c in ("INR", "USD")])


def scam_evidence(spark, sf_dir):
    records, events, _, issues, _ = _case_tables(spark, sf_dir)
    return evidence_table(records, events, issues).select("case_id", "rec_ord", "evidence_type", F.array_join("events", ",").alias("events"), F.array_join("flags", ",").alias("flags"))


def scam_assessment(spark, sf_dir):
    records, events, summary, issues, counts = _case_tables(spark, sf_dir)
    facts = sections(events, summary, issues, counts, records, redacted=False).summary
    k = F.col("key_facts")
    return facts.select("case_id", "assessment", k["evidence_count"].alias("evidence_count"), k["fraudulent_payment_count"].alias("payments"), k["failed_attempt_count"].alias("failed"), k["suspect_identifier_count"].alias("suspects"), k["flag_count"].alias("flags"), k["high_severity_flag_count"].alias("high"))


QUERIES = {f.__name__: f for f in (scam_timeline, scam_summary, scam_issues, scam_issue_counts, scam_attempts, scam_losses, scam_evidence, scam_assessment)}

_HUMAN = """CASE WHEN {s} IS NULL THEN NULL ELSE CASE WHEN {s} < 0 THEN '-' ELSE '' END || CASE WHEN abs({s}) < 60 THEN CAST(abs({s}) AS VARCHAR) || 's' ELSE trim(concat(
  CASE WHEN abs({s}) // 86400 > 0 THEN CAST(abs({s}) // 86400 AS VARCHAR) || 'd ' ELSE '' END,
  CASE WHEN abs({s}) % 86400 // 3600 > 0 THEN CAST(abs({s}) % 86400 // 3600 AS VARCHAR) || 'h ' ELSE '' END,
  CASE WHEN abs({s}) % 3600 // 60 > 0 THEN CAST(abs({s}) % 3600 // 60 AS VARCHAR) || 'm' ELSE '' END)) END END"""
_SCAM_SQL = f"""
WITH e AS (SELECT event_id AS k, user_id AS u, 'u' || user_id AS case_id, date_trunc('second', ts) AS t, CASE WHEN user_id % 10 = 9 AND event_type = 'purchase' THEN 'view' ELSE event_type END AS event_type,
    CASE event_id % 3 WHEN 0 THEN 'scam' || (user_id % 7) || '@ybl' WHEN 1 THEN 'shop' || (event_id % 13) || '@okaxis' END AS payee FROM events),
items AS (
  SELECT case_id, k AS rec_ord, CASE event_type WHEN 'error' THEN 'ask' WHEN 'signup' THEN 'bait' WHEN 'view' THEN 'chat' WHEN 'purchase' THEN 'pay' WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'bad' ELSE 'link' END END AS kind,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 13 <> 0 THEN CASE WHEN k % 6 = 0 THEN date_trunc('day', t) ELSE t END END WHEN k % 11 <> 0 THEN t END AS t,
    event_type = 'purchase' AND k % 6 = 0 AND k % 13 <> 0 AS day_only, CASE WHEN event_type = 'purchase' THEN payee END AS payee, CASE WHEN event_type = 'purchase' THEN 'me@okaxis' END AS payer,
    CASE WHEN event_type = 'purchase' AND k % 17 <> 0 THEN CAST(100 * (1 + k % 7) AS DOUBLE) END AS amt, CASE WHEN event_type = 'purchase' AND k % 10 = 3 THEN 'USD' END AS cur, 'debit' AS dir,
    CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_type = 'purchase' AND k % 4 <> 1 THEN 'TXN' || lpad(CAST(k AS VARCHAR), 8, '0') END AS txn,
    CASE WHEN event_type = 'error' THEN 'Agent ' || (k % 3) WHEN event_type = 'view' THEN 'Asha' END AS name, CASE WHEN event_type = 'error' THEN '+9198765' || lpad(CAST(u % 1000 * 10 + k % 2 AS VARCHAR), 5, '0') END AS ident,
    CASE WHEN event_type = 'error' THEN CAST(100 * (1 + k % 5) AS DOUBLE) END AS asked, CASE WHEN event_type = 'error' THEN 'scam' || (u % 7) || '@ybl' END AS named
  FROM e
  UNION ALL
  SELECT case_id, 10000000 + k, 'pay', t + CASE WHEN k % 4 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, false, CASE WHEN k % 2 = 0 THEN payee ELSE 'other@ybl' END, CASE WHEN k % 9 = 0 THEN 'scam' || (u % 7) || '@ybl' WHEN k % 5 = 1 THEN 'me2@okaxis' ELSE 'me@okaxis' END,
    CAST(100 * (1 + k % 7) + CASE WHEN k % 3 = 1 THEN 50 ELSE 0 END AS DOUBLE), CASE WHEN k % 20 = 3 THEN 'EUR' END, CASE WHEN k % 9 = 0 THEN 'credit' ELSE 'debit' END, CASE WHEN k % 8 = 0 THEN 'failed' ELSE 'success' END,
    'TXN' || lpad(CAST(k AS VARCHAR), 8, '0'), NULL, NULL, NULL, NULL
  FROM e WHERE event_type = 'purchase' AND k % 4 <> 1 AND k % 7 < 3
), named AS (SELECT case_id, named, count(*) AS links FROM items WHERE kind = 'ask' GROUP BY case_id, named),
contact AS (SELECT case_id, min(t) AS first_contact FROM items WHERE kind IN ('ask', 'bait', 'bad') GROUP BY case_id),
linked AS (
  SELECT i.*, CASE WHEN kind = 'pay' THEN coalesce(n.links, 0) ELSE 0 END AS links, kind = 'pay' AND dir = 'debit' AND n.links IS NULL AND coalesce(first_contact <= t, false) AS follows
  FROM items i LEFT JOIN named n ON n.case_id = i.case_id AND n.named = CASE dir WHEN 'debit' THEN i.payee ELSE i.payer END LEFT JOIN contact c ON c.case_id = i.case_id
), typed AS (
  SELECT *, CASE kind WHEN 'ask' THEN 'contact' WHEN 'bait' THEN 'contact' WHEN 'chat' THEN 'communication' WHEN 'link' THEN 'communication' WHEN 'bad' THEN 'lure' ELSE CASE WHEN links > 0 AND dir = 'debit' THEN 'fraud' ELSE 'transaction' END END AS stage0,
    CASE kind WHEN 'ask' THEN 'suspicious_message' WHEN 'bait' THEN 'suspicious_message' WHEN 'chat' THEN 'message' WHEN 'link' THEN 'url' WHEN 'bad' THEN 'malicious_url'
      ELSE CASE WHEN links > 0 AND dir = 'credit' THEN 'scammer_credit' WHEN links > 0 AND status = 'failed' THEN 'fraud_attempt' WHEN links > 0 THEN 'fraudulent_payment' WHEN status = 'failed' THEN 'failed_transaction' ELSE 'transaction' END END AS type0,
    CASE WHEN t IS NULL THEN 'unknown' WHEN day_only THEN 'date' ELSE 'datetime' END AS prec,
    CASE WHEN day_only THEN t + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND ELSE t END AS sort_at,
    CASE WHEN amt IS NULL THEN 'an unknown amount' WHEN cur IS NULL THEN '₹' || format('{{:,.2f}}', amt) ELSE cur || ' ' || format('{{:,.2f}}', amt) END AS money
  FROM linked
), ranked AS (
  SELECT *, CAST(row_number() OVER w AS INTEGER) AS sequence, coalesce(bool_or(stage0 = 'fraud') OVER (PARTITION BY case_id ORDER BY t IS NULL, sort_at, list_position(['communication', 'contact', 'lure', 'transaction', 'fraud'], stage0), rec_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after,
    last_value(CASE WHEN prec = 'datetime' THEN t END IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY t IS NULL, sort_at, list_position(['communication', 'contact', 'lure', 'transaction', 'fraud'], stage0), rec_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM typed WINDOW w AS (PARTITION BY case_id ORDER BY t IS NULL, sort_at, list_position(['communication', 'contact', 'lure', 'transaction', 'fraud'], stage0), rec_ord)
), f AS (
  SELECT *, CASE WHEN after AND type0 = 'suspicious_message' THEN 'follow_up_message' ELSE type0 END AS event_type, CASE WHEN after AND type0 = 'suspicious_message' THEN 'follow_up' ELSE stage0 END AS stage,
    CASE WHEN prec = 'datetime' THEN epoch_us(t) // 1000000 - epoch_us(before) // 1000000 END AS gap, CASE WHEN name IS NOT NULL AND ident IS NOT NULL THEN name || ' <' || ident || '>' ELSE coalesce(name, ident) END AS label, kind = 'pay' AS is_money,
    CASE WHEN after AND type0 = 'suspicious_message' THEN 'high' WHEN follows THEN 'medium' ELSE CASE type0 WHEN 'message' THEN 'info' WHEN 'url' THEN 'info' WHEN 'transaction' THEN 'low' WHEN 'failed_transaction' THEN 'low' WHEN 'suspicious_message' THEN 'medium' WHEN 'scammer_credit' THEN 'medium' WHEN 'malicious_url' THEN 'high' WHEN 'fraud_attempt' THEN 'high' ELSE 'critical' END END AS severity
  FROM ranked
), titled AS (
  SELECT *, CASE kind WHEN 'ask' THEN CASE WHEN event_type = 'follow_up_message' THEN 'Follow-up' ELSE 'Suspicious' END || ' message from ' || label WHEN 'bait' THEN CASE WHEN event_type = 'follow_up_message' THEN 'Follow-up' ELSE 'Suspicious' END || ' message received' WHEN 'chat' THEN 'Message from Asha'
    WHEN 'bad' THEN 'Malicious URL: sbi-kyc.top' WHEN 'link' THEN 'URL: example.com'
    ELSE CASE event_type WHEN 'fraud_attempt' THEN 'Fraud attempt: ' WHEN 'fraudulent_payment' THEN 'Fraudulent payment: ' ELSE '' END || CASE dir WHEN 'credit' THEN 'Credit of ' || money || ' from ' || payer ELSE 'Debit of ' || money || coalesce(' to ' || payee, '') END || CASE event_type WHEN 'scammer_credit' THEN ' (suspect account)' ELSE '' END END AS title
  FROM f
), refs AS (
  SELECT case_id, txn, list(sequence ORDER BY sequence) AS events, count(DISTINCT amt) AS amounts, count(DISTINCT cur) AS curs, count(DISTINCT dir) AS dirs, count(DISTINCT payee) AS payees, count(DISTINCT payer) AS payers, count(DISTINCT status) AS statuses,
    count(DISTINCT CAST(t AS DATE)) AS days, max(CASE WHEN prec = 'datetime' THEN t END) - min(CASE WHEN prec = 'datetime' THEN t END) AS spread, count(*) FILTER (event_type = 'fraudulent_payment') AS paid
  FROM f WHERE txn IS NOT NULL GROUP BY case_id, txn HAVING count(*) > 1
), conflicts AS (
  SELECT case_id, txn, events, paid, unnest([CASE WHEN amounts > 1 THEN ['amount_mismatch', 'high'] END, CASE WHEN curs > 1 THEN ['currency_mismatch', 'medium'] END, CASE WHEN dirs > 1 THEN ['direction_mismatch', 'high'] END, CASE WHEN payees > 1 THEN ['payee_mismatch', 'high'] END,
    CASE WHEN payers > 1 THEN ['payer_mismatch', 'medium'] END, CASE WHEN statuses > 1 THEN ['status_mismatch', 'high'] END, CASE WHEN days > 1 OR coalesce(spread > INTERVAL 1 HOUR, false) THEN ['timestamp_mismatch', 'medium'] END]) AS c FROM refs
), asks AS (SELECT p.case_id, p.sequence, p.amt, p.t, p.prec, a.sequence AS seen, a.asked, a.t AS at_t, p.cur FROM f p JOIN f a ON a.case_id = p.case_id AND a.named = p.payee WHERE p.links > 0 AND p.dir = 'debit'),
found AS (
  SELECT case_id, 'gap' AS category, 'missing_timestamp' AS issue_type, CASE WHEN is_money THEN 'high' ELSE 'medium' END AS severity, [sequence] AS events, sequence AS emit FROM f WHERE t IS NULL
  UNION ALL SELECT case_id, 'gap', 'date_only_timestamp', 'low', [sequence], sequence FROM f WHERE is_money AND prec = 'date'
  UNION ALL SELECT case_id, 'gap', 'missing_amount', CASE WHEN stage = 'fraud' THEN 'high' ELSE 'medium' END, [sequence], sequence FROM f WHERE is_money AND amt IS NULL
  UNION ALL SELECT case_id, 'gap', 'missing_counterparty', 'medium', [sequence], sequence FROM f WHERE is_money AND CASE dir WHEN 'debit' THEN payee ELSE payer END IS NULL
  UNION ALL SELECT case_id, 'gap', 'missing_transaction_id', CASE WHEN stage = 'fraud' THEN 'medium' ELSE 'low' END, [sequence], sequence FROM f WHERE is_money AND txn IS NULL
  UNION ALL SELECT case_id, 'gap', 'missing_sender_id', 'medium', [sequence], sequence FROM f WHERE event_type IN ('suspicious_message', 'follow_up_message') AND ident IS NULL
  UNION ALL SELECT case_id, 'gap', 'unlinked_debit', 'medium', [sequence], sequence FROM f WHERE follows
  UNION ALL SELECT case_id, 'gap', 'no_transaction_evidence', 'medium', CAST([] AS INTEGER[]), 0 FROM f GROUP BY case_id HAVING bool_or(stage IN ('contact', 'lure', 'follow_up')) AND NOT bool_or(is_money)
  UNION ALL SELECT case_id, 'contradiction', c[1], c[2], events, 0 FROM conflicts WHERE c IS NOT NULL
  UNION ALL SELECT case_id, 'duplicate', 'duplicate_transaction', CASE WHEN paid > 1 THEN 'medium' ELSE 'low' END, events, 0 FROM refs r WHERE NOT EXISTS (SELECT 1 FROM conflicts c WHERE c.case_id = r.case_id AND c.txn = r.txn AND c.c IS NOT NULL)
  UNION ALL SELECT case_id, 'contradiction', 'requested_amount_mismatch', 'medium', list_sort(list_append(list(seen), sequence)), sequence FROM asks WHERE amt IS NOT NULL AND cur IS NULL GROUP BY case_id, sequence HAVING NOT bool_or(asked = amt)
  UNION ALL SELECT case_id, 'contradiction', 'sender_id_conflict', 'medium', list(DISTINCT sequence ORDER BY sequence), 0 FROM f WHERE name IS NOT NULL AND ident IS NOT NULL GROUP BY case_id, name HAVING count(DISTINCT ident) > 1
  UNION ALL SELECT case_id, 'contradiction', 'identifier_name_conflict', 'low', list(DISTINCT sequence ORDER BY sequence), 0 FROM f WHERE name IS NOT NULL AND ident IS NOT NULL GROUP BY case_id, ident HAVING count(DISTINCT name) > 1
  UNION ALL SELECT case_id, 'contradiction', 'payment_before_contact', 'medium', list_sort(list_append(list(seen), sequence)), sequence FROM asks WHERE t IS NOT NULL AND at_t IS NOT NULL GROUP BY case_id, sequence HAVING bool_and(CASE prec WHEN 'datetime' THEN t < at_t ELSE CAST(t AS DATE) < CAST(at_t AS DATE) END)
), issues AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY list_position(['high', 'medium', 'low'], severity), list_position(['contradiction', 'gap', 'duplicate'], category), coalesce(events[1], 0), issue_type, emit) AS INTEGER) AS n FROM found
), tried AS (SELECT * FROM titled WHERE event_type IN ('suspicious_message', 'malicious_url', 'fraud_attempt', 'fraudulent_payment', 'follow_up_message', 'scammer_credit')),
once AS (SELECT *, row_number() OVER (PARTITION BY case_id, coalesce(txn, CAST(sequence AS VARCHAR)) ORDER BY sequence) AS nth FROM f WHERE event_type = 'fraudulent_payment')
"""
_CONTACTED = "CASE event_type WHEN 'malicious_url' THEN '{0}' WHEN 'fraud_attempt' THEN '{1}' WHEN 'fraudulent_payment' THEN '{2}' WHEN 'follow_up_message' THEN '{3}' WHEN 'scammer_credit' THEN '{5}' ELSE '{4}' END"
_LABEL = "CASE event_type WHEN 'suspicious_message' THEN 'suspicious message' WHEN 'follow_up_message' THEN 'follow-up message' WHEN 'malicious_url' THEN 'malicious URL' WHEN 'transaction' THEN 'transaction' WHEN 'failed_transaction' THEN 'failed transaction' WHEN 'fraudulent_payment' THEN 'fraudulent payment' WHEN 'fraud_attempt' THEN 'fraud attempt' WHEN 'scammer_credit' THEN 'credit from suspect' END"

ORACLES = {
    "scam_timeline": _SCAM_SQL + "SELECT case_id, sequence, event_type, stage, severity, prec AS time_precision, " + _HUMAN.format(s="gap") + " AS since_previous, title, CAST(links AS INTEGER) AS links, CASE kind WHEN 'ask' THEN 'credential_request,payment_request' WHEN 'bait' THEN 'urgency,reward_bait' ELSE '' END AS indicators FROM titled",
    "scam_summary": _SCAM_SQL + f""", s AS (SELECT case_id, count(DISTINCT rec_ord) AS evidence_count, count(*) AS event_count, count(*) FILTER (t IS NULL) AS undated_event_count, arg_min(t, sequence) FILTER (t IS NOT NULL) AS t0, arg_max(t, sequence) FILTER (t IS NOT NULL) AS t1, count(t) AS dated,
      arg_min(t, sequence) FILTER (t IS NOT NULL AND stage IN ('contact', 'lure')) AS tc, arg_min(t, sequence) FILTER (t IS NOT NULL AND event_type = 'fraudulent_payment') AS tl,
      array_to_string(list_filter(['communication', 'contact', 'lure', 'transaction', 'fraud', 'follow_up'], lambda x: list_contains(list(DISTINCT stage), x)), ',') AS stages, count(*) FILTER (event_type = 'fraudulent_payment') AS fraudulent_payment_count,
      round(sum(amt) FILTER (event_type = 'fraudulent_payment' AND cur IS NULL), 2) AS inr, round(sum(amt) FILTER (event_type = 'fraudulent_payment' AND cur = 'USD'), 2) AS usd,
      coalesce(string_agg(DISTINCT CASE WHEN stage = 'fraud' THEN payee WHEN stage IN ('contact', 'lure', 'follow_up') THEN ident END, ',' ORDER BY CASE WHEN stage = 'fraud' THEN payee WHEN stage IN ('contact', 'lure', 'follow_up') THEN ident END), '') AS suspects,
      ['info', 'low', 'medium', 'high', 'critical'][max(list_position(['info', 'low', 'medium', 'high', 'critical'], severity))] AS highest_severity FROM f GROUP BY case_id),
    g AS (SELECT *, CASE WHEN dated > 1 THEN epoch_us(t1) // 1000000 - epoch_us(t0) // 1000000 END AS d, CASE WHEN tl >= tc THEN epoch_us(tl) // 1000000 - epoch_us(tc) // 1000000 END AS l FROM s),
    c AS (SELECT case_id, string_agg(label, ' → ' ORDER BY first_at) AS attack_chain FROM (SELECT case_id, {_LABEL} AS label, min(sequence) AS first_at FROM f WHERE t IS NOT NULL GROUP BY ALL HAVING label IS NOT NULL) GROUP BY case_id)
    SELECT case_id, evidence_count, event_count, undated_event_count, {_HUMAN.format(s='d')} AS duration, attack_chain, stages, fraudulent_payment_count, inr, usd, {_HUMAN.format(s='l')} AS time_to_first_loss, suspects, highest_severity FROM g LEFT JOIN c USING (case_id)""",
    "scam_issues": _SCAM_SQL + "SELECT case_id, printf('ISSUE-%03d', n) AS issue_id, category, issue_type, severity, array_to_string(events, ',') AS events, CAST(len(events) AS INTEGER) AS evidence FROM issues",
    "scam_issue_counts": _SCAM_SQL + "SELECT e.case_id, e.n AS events_checked, count(i.n) AS issue_count, arg_min(i.severity, i.n) AS highest_severity, " + ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in ("contradiction", "gap", "duplicate")) + ", " + ", ".join(f"count(*) FILTER (severity = '{c}') AS {c}" for c in ("high", "medium", "low")) + " FROM (SELECT case_id, count(*) AS n FROM f GROUP BY case_id) e LEFT JOIN issues i USING (case_id) GROUP BY ALL",
    "scam_attempts": _SCAM_SQL + "SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY sequence) AS INTEGER) AS entry, sequence, event_type, " + _CONTACTED.format("Phishing link sent", "Payment to suspect attempted", "Payment to suspect", "Follow-up demand after loss", "Scam contact", "Credit from suspect account") + " AS action, " + _CONTACTED.format("link sent", "failed", "money lost", "contacted", "contacted", "received") + " AS outcome, CASE WHEN kind = 'bad' THEN 'URL' END AS channel, CASE WHEN kind = 'pay' THEN CASE dir WHEN 'debit' THEN payee ELSE payer END ELSE label END AS counterparty, amt AS amount, coalesce(cur, CASE WHEN amt IS NOT NULL THEN 'INR' END) AS currency, txn AS transaction_id FROM tried",
    "scam_losses": _SCAM_SQL + "SELECT case_id, count(*) AS payment_count, round(sum(amt) FILTER (cur IS NULL), 2) AS inr, round(sum(amt) FILTER (cur = 'USD'), 2) AS usd FROM once WHERE nth = 1 GROUP BY case_id",
    "scam_evidence": _SCAM_SQL + ", hits AS (SELECT case_id, printf('ISSUE-%03d', n) AS issue_id, n, unnest(events) AS sequence FROM issues), fl AS (SELECT case_id, sequence, string_agg(issue_id, ',' ORDER BY n) AS flags FROM hits GROUP BY case_id, sequence) SELECT f.case_id, CAST(rec_ord AS INTEGER) AS rec_ord, CASE kind WHEN 'pay' THEN 'transaction' WHEN 'bad' THEN 'url' WHEN 'link' THEN 'url' ELSE 'message' END AS evidence_type, CAST(f.sequence AS VARCHAR) AS events, coalesce(flags, '') AS flags FROM f LEFT JOIN fl ON fl.case_id = f.case_id AND fl.sequence = f.sequence",
    "scam_assessment": _SCAM_SQL + """, p AS (SELECT case_id, count(*) AS n FROM once WHERE nth = 1 GROUP BY case_id), i AS (SELECT case_id, count(*) AS n, count(*) FILTER (severity = 'high') AS high FROM issues GROUP BY case_id)
    SELECT f.case_id, CASE WHEN count(*) FILTER (event_type = 'fraudulent_payment') > 0 THEN 'Fraud with financial loss' WHEN count(*) FILTER (event_type = 'fraud_attempt') > 0 THEN 'Attempted fraud, no confirmed loss' WHEN count(*) FILTER (stage IN ('contact', 'lure', 'follow_up')) > 0 THEN 'Suspicious contact, no payment found' ELSE 'No fraud indicators found' END AS assessment,
      CAST(count(*) AS INTEGER) AS evidence_count, CAST(coalesce(any_value(p.n), 0) AS INTEGER) AS payments, CAST(count(*) FILTER (event_type = 'fraud_attempt') AS INTEGER) AS failed, CAST(count(DISTINCT CASE WHEN stage = 'fraud' THEN payee WHEN stage IN ('contact', 'lure', 'follow_up') THEN ident END) AS INTEGER) AS suspects, CAST(coalesce(any_value(i.n), 0) AS INTEGER) AS flags, CAST(coalesce(any_value(i.high), 0) AS INTEGER) AS high
    FROM f LEFT JOIN p USING (case_id) LEFT JOIN i USING (case_id) GROUP BY f.case_id""",
}
