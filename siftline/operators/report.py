"""The incident report (M6): executive summary, timeline, evidence, flags, attempt log; a row for each case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions.dates import DEFAULT_ZONE, minute_text
from siftline.functions.parties import format_money, party_label, reference_key
from siftline.functions.text import plural, snippet
from siftline.operators.checks import check
from siftline.operators.redact import redact
from siftline.operators.timeline import build_timeline
from siftline.storage import settle

REPORT_VERSION = "1.0"
# Events of the attempt log, what they are and how they end; channels.
ATTEMPTS = {
    "suspicious_message": ("Scam contact", "contacted"),
    "malicious_url": ("Phishing link sent", "link sent"),
    "suspicious_url": ("Suspicious link sent", "link sent"),
    "scammer_credit": ("Credit from suspect account", "received"),
    "fraud_attempt": ("Payment to suspect attempted", "failed"),
    "fraudulent_payment": ("Payment to suspect", "money lost"),
    "follow_up_message": ("Follow-up demand after loss", "contacted"),
}
CHANNELS = {"sms": "SMS", "email": "email", "chat": "chat"}
_CONTACT = ["contact", "lure", "follow_up"]


@dataclass
class Sections:
    """Tables by case_id; all that a report is made of, for any number of cases."""

    summary: DataFrame
    timeline: DataFrame
    evidence: DataFrame
    flags: DataFrame
    attempts: DataFrame


def _pick(col: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col)


def attempt_log(events: DataFrame) -> DataFrame:
    e = events.filter(F.col("event_type").isin(list(ATTEMPTS)))
    other = F.when(F.coalesce(F.col("amount.direction") == "debit", F.lit(False)), F.col("actors.to")).otherwise(F.col("actors.from"))
    channel = F.coalesce(F.when(F.col("details.platform").isin(list(CHANNELS)), _pick(F.coalesce("details.platform", F.lit("sms")), CHANNELS)), F.when(F.col("details.payment_method") != "", F.col("details.payment_method")), F.when(F.col("url") != "", "URL"))
    currency = F.coalesce(F.when(F.col("amount.currency") != "", F.col("amount.currency")), F.when(F.col("amount.value").isNotNull(), "INR"))
    return e.select(
        "case_id", F.row_number().over(W.partitionBy("case_id").orderBy("sequence")).alias("entry"), "sequence", "timestamp", "event_type", _pick(F.col("event_type"), {k: v[0] for k, v in ATTEMPTS.items()}).alias("action"),
        channel.alias("channel"), party_label(other).alias("counterparty"), F.col("amount.value").alias("amount"), currency.alias("currency"), F.col("details.transaction_id").alias("transaction_id"), "url",
        _pick(F.col("event_type"), {k: v[1] for k, v in ATTEMPTS.items()}).alias("outcome"), "severity", "evidence_id", "linked_evidence",
    )


def _cross_references(events: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    of_events = events.groupBy("case_id", "evidence_id").agg(F.sort_array(F.collect_list("sequence")).alias("events"), F.min_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("sequence"))).alias("first_time"))
    of_flags = issues.select("case_id", "n", "issue_id", F.explode("evidence_ids").alias("evidence_id")).groupBy("case_id", "evidence_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "issue_id"))), lambda x: x["issue_id"]).alias("flags"))
    return of_events, of_flags


def _referenced(rows: DataFrame, of: DataFrame, names: list[str]) -> DataFrame:
    right = of.select(F.col("case_id").alias("c"), F.col("evidence_id").alias("i"), *names)
    return rows.join(right, (rows["case_id"] == right["c"]) & rows["evidence_id"].eqNullSafe(right["i"]), "left").drop("c", "i")


def evidence_table(records: DataFrame, events: DataFrame, issues: DataFrame) -> DataFrame:
    """A row for each record, with the events and flags that refer to it."""
    of_events, of_flags = _cross_references(events, issues)
    n, t, m = F.size("transactions"), F.col("transaction"), F.col("message")
    direction = F.initcap(F.coalesce(F.when(t["direction"] != "", t["direction"]), F.lit("debit")))
    one = F.concat(direction, F.lit(" of "), format_money(t["amount"], t["currency"]), F.coalesce(F.concat(F.lit(", ref "), F.when(t["transaction_id"] != "", t["transaction_id"])), F.lit("")))
    said = F.concat(F.coalesce(F.concat(F.lit("Subject: "), F.when(m["subject"] != "", m["subject"]), F.lit(". ")), F.lit("")), F.lit('"'), snippet(m["content"], 100), F.lit('"'))
    links = F.array_join(F.transform("urls", lambda u: F.concat(u["url"], F.lit(" ("), u["verdict"], F.lit(", score "), u["score"].cast("string"), F.lit(")"))), "; ")
    summary = F.when(n > 1, plural(n, "transaction")).when(n == 1, one).when(m.isNotNull(), said).when(F.size("urls") > 0, links).otherwise("")
    rows = records.select("case_id", "rec_ord", "evidence_id", "evidence_type", "source", "timestamp", party_label(F.col("sender")).alias("sender"), party_label(F.col("receiver")).alias("receiver"), summary.alias("summary"), "content_hash", "warnings")
    rows = _referenced(_referenced(rows, of_events, ["events", "first_time"]), of_flags, ["flags"])
    return rows.select("case_id", "rec_ord", "evidence_id", "evidence_type", "source", F.coalesce("first_time", "timestamp").alias("timestamp"), "sender", "receiver", "summary", "content_hash", "warnings", F.coalesce("events", F.array().cast("array<int>")).alias("events"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))


def evidence_from_events(events: DataFrame, issues: DataFrame) -> DataFrame:
    """The evidence table of a timeline without records: the first event of each evidence id."""
    of_events, of_flags = _cross_references(events, issues)
    first = events.withColumn("k", F.row_number().over(W.partitionBy("case_id", "evidence_id").orderBy("sequence"))).filter("k = 1")
    none = F.lit(None).cast("string")
    rows = first.select("case_id", F.col("sequence").alias("rec_ord"), "evidence_id", "evidence_type", none.alias("source"), "timestamp", party_label(F.col("actors.from")).alias("sender"), party_label(F.col("actors.to")).alias("receiver"), F.col("description").alias("summary"), none.alias("content_hash"), F.array().cast("array<string>").alias("warnings"))
    rows = _referenced(_referenced(rows, of_events, ["events"]), of_flags, ["flags"])
    return rows.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def unique_losses(attempts: DataFrame) -> DataFrame:
    """case_id, unique_loss and payment_count with a payment in several documents counted once; those without a reference all count."""
    paid = attempts.filter(F.col("event_type") == "fraudulent_payment").withColumn("ref", reference_key(F.col("transaction_id")))
    nth = F.row_number().over(W.partitionBy("case_id", F.coalesce("ref", F.concat(F.lit("\x00"), F.col("sequence").cast("string")))).orderBy("sequence"))
    once = paid.withColumn("nth", nth).filter("nth = 1")
    per = once.groupBy("case_id", "currency").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("loss"))
    amounts = F.filter(F.array_sort(F.collect_list(F.struct("currency", "loss"))), lambda x: x["loss"].isNotNull())
    return per.groupBy("case_id").agg(F.sum("n").alias("payment_count"), F.map_from_entries(amounts).alias("unique_loss"))


def executive_summary(summary: DataFrame, events: DataFrame, issue_summary: DataFrame, attempts: DataFrame, evidence: DataFrame, redacted: bool) -> DataFrame:
    is_contact = F.col("stage").isin(_CONTACT)
    platform = F.when(is_contact & F.col("details.platform").isin(list(CHANNELS)), _pick(F.coalesce("details.platform", F.lit("sms")), CHANNELS))
    seen = events.groupBy("case_id").agg(
        F.count(F.when(is_contact, 1)).alias("n_contacts"), F.count(F.when(is_contact & F.col("event_type").isin("suspicious_message", "follow_up_message"), 1)).alias("n_messages"),
        F.count(F.when(is_contact & (F.col("url") != ""), 1)).alias("n_links"), F.sort_array(F.collect_set(platform)).alias("contact_channels"),
        F.min_by("timestamp", F.when(is_contact & F.col("timestamp").isNotNull(), F.col("sequence"))).alias("first_contact_at"),
    )
    tried = attempts.groupBy("case_id").agg(
        F.count(F.when(F.col("event_type") == "fraudulent_payment", 1)).alias("n_paid"), F.count(F.when(F.col("event_type") == "fraud_attempt", 1)).alias("n_failed"),
        F.min_by("timestamp", F.when((F.col("event_type") == "fraudulent_payment") & F.col("timestamp").isNotNull(), F.col("sequence"))).alias("first_loss_at"),
    )
    n_evidence = evidence.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    s = summary.join(seen, "case_id", "left").join(tried, "case_id", "left").join(unique_losses(attempts), "case_id", "left").join(issue_summary.drop("highest_severity"), "case_id", "left").join(n_evidence, "case_id", "left")
    zero = ["n_contacts", "n_messages", "n_links", "n_paid", "n_failed", "payment_count", "issue_count", "n_evidence"]
    s = s.withColumns({c: F.coalesce(c, F.lit(0)).cast("int") for c in zero} | {"contact_channels": F.coalesce("contact_channels", F.array().cast("array<string>")), "loss": F.coalesce("unique_loss", F.create_map().cast("map<string,double>"))})
    c = F.col
    high = F.coalesce(F.try_element_at("by_severity", F.lit("high")), F.lit(0)).cast("int")
    gaps, contradictions = (F.coalesce(F.try_element_at("by_category", F.lit(k)), F.lit(0)) for k in ("gap", "contradiction"))
    first, last = minute_text(c("first_event_at")), minute_text(c("last_event_at"))
    period = F.when(first != last, F.concat(F.lit("between "), first, F.lit(" and "), last)).otherwise(F.concat(F.lit("on "), first))
    channels = F.when(F.size("contact_channels") > 0, F.concat(F.lit(" by "), F.array_join("contact_channels", " and "))).otherwise("")
    parts = F.concat_ws(" and ", F.when(c("n_messages") > 0, F.concat(plural(c("n_messages"), "suspicious message"), channels)), F.when(c("n_links") > 0, plural(c("n_links"), "malicious or suspicious link")))
    money = F.array_join(F.transform(F.map_entries("loss"), lambda x: format_money(x["value"], x["key"])), ", ")
    money = F.when(money == "", "an unknown amount").otherwise(money)
    paid = F.concat(
        F.when(c("payment_count") == 1, F.concat(F.lit("1 fraudulent payment of "), money, F.lit(" was made"))).otherwise(F.concat(c("payment_count").cast("string"), F.lit(" fraudulent payments totalling "), money, F.lit(" were made"))),
        F.when(c("n_paid") > c("payment_count"), F.concat(F.lit(" (recorded in "), c("n_paid").cast("string"), F.lit(" documents)"))).otherwise(""),
        F.coalesce(F.concat(F.lit(", the first "), c("time_to_first_loss"), F.lit(" after first contact")), F.lit("")), F.lit("."),
    )
    n_suspects = F.size("suspect_identifiers")
    found = F.concat(n_suspects.cast("string"), F.when(n_suspects == 1, " suspect identifier was found (redacted in this report).").otherwise(" suspect identifiers were found (redacted in this report).")) if redacted else F.concat(F.lit("Suspect identifiers: "), F.array_join("suspect_identifiers", ", "), F.lit("."))
    review = F.concat(F.lit("Review found "), gaps.cast("string"), F.lit(" gap(s) and "), contradictions.cast("string"), F.lit(" contradiction(s) in the evidence"), F.when(high > 0, F.concat(F.lit(", "), high.cast("string"), F.lit(" of them high severity"))).otherwise(""), F.lit("; see the flags section before filing."))
    text = F.concat_ws(
        " ", F.when(c("first_event_at").isNotNull(), F.concat(F.lit("The evidence ("), plural(c("n_evidence"), "item"), F.lit(") covers events "), period, F.lit("."))),
        F.when(parts != "", F.concat(F.lit("The victim received "), parts, F.lit("."))), F.when(c("attack_chain").isNotNull(), F.concat(F.lit("The attack followed this sequence: "), c("attack_chain"), F.lit("."))),
        F.when(c("n_paid") > 0, paid), F.when(c("n_failed") > 0, F.concat(plural(c("n_failed"), "further payment attempt"), F.lit(" to the suspects failed."))), F.when(n_suspects > 0, found),
        F.when(c("issue_count") > 0, review).when(c("event_count") > 0, "No gaps or contradictions were found in the evidence."),
    )
    assessment = F.when(c("n_paid") > 0, "Fraud with financial loss").when(c("n_failed") > 0, "Attempted fraud, no confirmed loss").when(c("n_contacts") > 0, "Suspicious contact, no payment found").otherwise("No fraud indicators found")
    facts = F.struct(
        c("n_evidence").alias("evidence_count"), c("event_count").cast("int").alias("event_count"), "first_event_at", "last_event_at", "first_contact_at", "first_loss_at", "attack_chain", "contact_channels",
        c("payment_count").alias("fraudulent_payment_count"), c("n_failed").alias("failed_attempt_count"), c("loss").alias("total_loss"), n_suspects.alias("suspect_identifier_count"), "highest_severity",
        c("issue_count").alias("flag_count"), high.alias("high_severity_flag_count"),
    )
    return s.select("case_id", assessment.alias("assessment"), F.when(text == "", "No evidence was provided.").otherwise(text).alias("text"), facts.alias("key_facts"))


def sections(timeline: DataFrame, summary: DataFrame, issues: DataFrame, issue_summary: DataFrame, records: DataFrame | None, redacted: bool = True) -> Sections:
    attempts = attempt_log(timeline)
    evidence = evidence_table(records, timeline, issues) if records is not None else evidence_from_events(timeline, issues)
    rows = timeline.select("case_id", "sequence", "timestamp", "time_precision", "since_previous", "stage", "event_type", "severity", "title", "description", "evidence_id")
    flags = issues.select("case_id", "n", "issue_id", "category", "issue_type", "severity", "title", "description", "events", "evidence_ids", "suggestion")
    return Sections(executive_summary(summary, timeline, issue_summary, attempts, evidence, redacted), rows, evidence, flags, attempts)


def assemble(s: Sections, issue_summary: DataFrame, generated_at: str, zone: str = DEFAULT_ZONE, redacted: bool = True) -> DataFrame:
    """One nested row for each case."""

    def nested(df: DataFrame, order: str, name: str) -> DataFrame:
        cols = [c for c in df.columns if c not in ("case_id", order) or c in ("sequence", "entry")]
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*cols).alias("r"))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
        return df.groupBy("case_id").agg(F.transform(rows, lambda x: x["r"]).alias(name))

    out = s.summary.select("case_id", F.struct("assessment", "text", "key_facts").alias("executive_summary"))
    for df, order, name in ((s.timeline, "sequence", "timeline"), (s.evidence, "rec_ord", "evidence"), (s.flags, "n", "issues"), (s.attempts, "entry", "fraud_attempt_log")):
        part = nested(df, order, name)
        kind = part.schema[name].dataType
        out = out.join(part, "case_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    out = out.join(issue_summary.select("case_id", F.struct("events_checked", "issue_count", "by_category", "by_severity", "highest_severity").alias("flag_summary")), "case_id", "left")
    return out.select("case_id", F.lit(REPORT_VERSION).alias("report_version"), F.lit(generated_at).alias("generated_at"), F.lit(zone).alias("timezone"), F.lit(redacted).alias("redacted"), "executive_summary", "timeline", "evidence", F.struct(F.col("flag_summary").alias("summary"), "issues").alias("flags"), "fraud_attempt_log")


def build_report(records: DataFrame, generated_at: str, zone: str = DEFAULT_ZONE, redacted: bool = True) -> DataFrame:
    """M3 to M6 on records: a report row for each case. The evidence is redacted within its case, then the whole report.

    Records, timeline, issues and the report are settled in between: each is used by several sections.
    """
    records = settle(records)
    timeline, summary = (settle(df) for df in build_timeline(records, zone))
    issues, issue_summary = check(timeline)
    issues = settle(issues)
    shown = settle(redact(records).drop("redactions")) if redacted else records
    s = sections(timeline, summary, issues, issue_summary, shown, redacted)
    report = settle(assemble(s, issue_summary, generated_at, zone, redacted))
    return redact(report, order=None).drop("redactions") if redacted else report
