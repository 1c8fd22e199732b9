"""Records to an ordered, linked timeline and its summary (M3).

A case is the unit: linking is one equi-join on (case, identifier), ordering and follow-ups are windows over
the case, the summary is one aggregation. A case of millions of events is sorted by one task, which spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions.dates import DEFAULT_ZONE, humanize, resolve
from siftline.functions.indicators import find_indicators, is_suspicious
from siftline.functions.parties import PARTY, format_money, party_label
from siftline.functions.text import capitalize_first, snippet

# Stages in the order of an attack, event labels, severities, words of failure.
STAGES = ["communication", "contact", "lure", "transaction", "fraud", "follow_up"]
LABELS = {
    "message": "message", "suspicious_message": "suspicious message", "follow_up_message": "follow-up message", "malicious_url": "malicious URL", "suspicious_url": "suspicious URL",
    "url": "URL", "transaction": "transaction", "failed_transaction": "failed transaction", "scammer_credit": "credit from suspect", "fraudulent_payment": "fraudulent payment", "fraud_attempt": "fraud attempt",
}
SEVERITIES = {
    "message": "info", "url": "info", "transaction": "low", "failed_transaction": "low", "suspicious_message": "medium", "suspicious_url": "medium", "scammer_credit": "medium",
    "malicious_url": "high", "follow_up_message": "high", "fraud_attempt": "high", "fraudulent_payment": "critical",
}
SEVERITY_RANK = ["info", "low", "medium", "high", "critical"]
FAILED_STATUSES = ["failed", "declined", "rejected", "reversed", "cancelled"]
CHANNELS = {"sms": "SMS", "email": "Email", "chat": "Chat message"}

MONEY = "struct<value:double,currency:string,direction:string>"
CONTACTS = "struct<phone_numbers:array<string>,emails:array<string>,upi_ids:array<string>,reference_numbers:array<string>>"
DETAILS = f"struct<platform:string,contacts:{CONTACTS},amounts_mentioned:array<struct<value:double,currency:string,raw:string>>,score:int,verdict:string,domain:string,transaction_id:string,payment_method:string,status:string,follows_suspicious_contact:boolean>"
_EVENT = f"struct<event_type:string,stage:string,title:string,description:string,iso:string,sender:{PARTY},receiver:{PARTY},amount:{MONEY},url:string,indicators:array<string>,details:{DETAILS},has_time:boolean>"
EVENTS = f"case_id string, sequence int, event_type string, stage string, title string, description string, evidence_id string, evidence_type string, timestamp string, time_precision string, severity string, actors struct<from:{PARTY},to:{PARTY}>, amount {MONEY}, url string, indicators array<string>, linked_evidence array<string>, details {DETAILS}, since_previous string"


def _table(col: Column, values: dict[str, str] | list[str]) -> Column:
    items = values.items() if isinstance(values, dict) else ((v, i) for i, v in enumerate(values))
    return F.element_at(F.create_map(*[F.lit(x) for kv in items for x in kv]), col)


def _event(**fields: Column) -> Column:
    """An event struct; fields that aren't given are null."""
    names = ["event_type", "stage", "title", "description", "iso", "sender", "receiver", "amount", "url", "indicators", "details", "has_time"]
    types = {"sender": PARTY, "receiver": PARTY, "amount": MONEY, "indicators": "array<string>", "details": DETAILS, "has_time": "boolean"}
    return F.struct(*[fields.get(n, F.lit(None)).cast(types.get(n, "string")).alias(n) for n in names])


def _details(**fields: Column) -> Column:
    types = {"contacts": CONTACTS, "amounts_mentioned": "array<struct<value:double,currency:string,raw:string>>", "score": "int", "follows_suspicious_contact": "boolean"}
    names = ["platform", "contacts", "amounts_mentioned", "score", "verdict", "domain", "transaction_id", "payment_method", "status", "follows_suspicious_contact"]
    return F.struct(*[fields.get(n, F.lit(None)).cast(types.get(n, "string")).alias(n) for n in names]).cast(DETAILS)


def _payment_event(txn: Column, has_time: bool = True) -> Column:
    status = F.lower(F.coalesce(txn["status"], F.lit("")))
    direction = F.coalesce(F.when(txn["direction"] != "", txn["direction"]), F.lit("debit"))
    money, sender, receiver = format_money(txn["amount"], txn["currency"]), party_label(txn["sender"]), party_label(txn["receiver"])
    credit = direction == "credit"
    title = F.when(credit, F.concat(F.lit("Credit of "), money, F.coalesce(F.concat(F.lit(" from "), sender), F.lit("")))).otherwise(F.concat(F.lit("Debit of "), money, F.coalesce(F.concat(F.lit(" to "), receiver), F.lit(""))))
    words = F.concat_ws(" ", F.when(~credit, F.concat(F.lit("from "), sender)), F.when(credit, F.concat(F.lit("to "), receiver)), F.when(txn["payment_method"] != "", F.concat(F.lit("via "), txn["payment_method"])), F.when(txn["transaction_id"] != "", F.concat(F.lit("ref "), txn["transaction_id"])), F.when(status != "", F.concat(F.lit("status "), status)))
    return _event(
        event_type=F.when(status.isin(FAILED_STATUSES), "failed_transaction").otherwise("transaction"), stage=F.lit("transaction"), title=title,
        description=capitalize_first(F.when(words == "", "transaction").otherwise(words)), iso=txn["timestamp"], sender=txn["sender"], receiver=txn["receiver"],
        amount=F.struct(txn["amount"].alias("value"), txn["currency"].alias("currency"), direction.alias("direction")),
        details=_details(transaction_id=txn["transaction_id"], payment_method=txn["payment_method"], status=txn["status"]),
        **{"has_time": txn["has_time"]} if has_time else {},
    )


def _link_event(url: Column, iso: Column, sender: Column) -> Column:
    kind = F.when(url["verdict"] == "malicious", "malicious_url").when(url["verdict"] == "suspicious", "suspicious_url").otherwise("url")
    label = F.when(url["verdict"] == "malicious", "Malicious URL").when(url["verdict"] == "suspicious", "Suspicious URL").otherwise("URL")
    reasons = F.transform(F.filter(url["signals"], lambda s: s["weight"] > 0), lambda s: F.replace(s["name"], F.lit("_"), F.lit(" ")))
    listed = F.when(F.size(reasons) > 0, F.concat(F.lit(": "), F.array_join(F.slice(reasons, 1, 4), ", "))).otherwise("")
    return _event(
        event_type=kind, stage=F.when(kind == "url", "communication").otherwise("lure"),
        title=F.concat(label, F.coalesce(F.concat(F.lit(" shared by "), party_label(sender)), F.lit("")), F.lit(": "), url["domain"]),
        description=F.concat(url["url"], F.lit(" (reputation score "), url["score"].cast("string"), F.lit("/100"), listed, F.lit(")")),
        iso=iso, sender=sender, url=url["url"], details=_details(score=url["score"], verdict=url["verdict"], domain=url["domain"]),
    )


def events_of(records: DataFrame) -> DataFrame:
    """Events of each record, not linked or ordered yet; one pass, no shuffle. Payments exclude a record's other events."""
    message = F.col("message")
    bad = F.filter("urls", lambda u: u["verdict"].isin("malicious", "suspicious"))
    df = records.withColumn("indicators", find_indicators(F.concat(F.coalesce(message["subject"], F.lit("")), F.lit("\n"), F.coalesce(message["content"], F.lit("")))))
    df = df.withColumn("suspicious", is_suspicious(F.col("indicators"), F.coalesce(F.size(bad) > 0, F.lit(False))))
    platform = message["platform"]
    channel = F.when(platform == "sms", CHANNELS["sms"]).when(platform == "email", CHANNELS["email"]).when(platform == "chat", CHANNELS["chat"]).when(F.col("evidence_type") == "screenshot", "Screenshot").otherwise("Message")
    lowered = F.when(channel == F.upper(channel), channel).otherwise(F.lower(channel))
    who = F.coalesce(F.concat(F.lit(" from "), party_label(F.col("sender"))), F.lit(" received"))
    title = F.concat(F.when(F.col("suspicious"), F.concat(F.lit("Suspicious "), lowered)).otherwise(channel), who)
    listed = F.when(F.size("indicators") > 0, F.concat(F.lit(" — indicators: "), F.array_join(F.transform("indicators", lambda i: F.replace(i, F.lit("_"), F.lit(" "))), ", "))).otherwise("")
    subject = F.when(message["subject"] != "", F.concat(F.lit("Subject: "), message["subject"], F.lit(". "))).otherwise("")
    description = F.concat(F.coalesce(subject, F.lit("")), F.lit('"'), snippet(message["content"], 80), F.lit('"'), listed)
    said = _event(
        event_type=F.when(F.col("suspicious"), "suspicious_message").otherwise("message"), stage=F.when(F.col("suspicious"), "contact").otherwise("communication"),
        title=title, description=description, iso=F.col("timestamp"), sender=F.col("sender"), receiver=F.col("receiver"), indicators=F.col("indicators"),
        details=_details(platform=platform, contacts=F.col("contacts"), amounts_mentioned=message["amounts_mentioned"]),
    )
    none = F.lit(None).cast(PARTY)
    flagged = "has_time" in records.schema["transactions"].dataType.elementType.names  # records of older stores aren't
    found = (
        F.when(F.size("transactions") > 0, F.transform("transactions", lambda t: _payment_event(t, flagged)))
        .when(F.col("evidence_type") == "url", F.transform("urls", lambda u: _link_event(u, F.col("timestamp"), none)))
        .when(message.isNotNull(), F.concat(F.array(said), F.transform(bad, lambda u: _link_event(u, F.col("timestamp"), F.col("sender")))))
    )
    source = F.try_element_at("field_sources", F.lit("timestamp"))
    rows = df.select("case_id", "rec_ord", "evidence_id", "evidence_type", source.alias("time_source"), F.posexplode(found.cast(f"array<{_EVENT}>")).alias("sub_ord", "e"))
    return rows.select("case_id", "rec_ord", "sub_ord", "evidence_id", "evidence_type", "time_source", "e.*")


def _link(events: DataFrame) -> DataFrame:
    """Payments whose counterparty is named by suspicious contact become fraud; other debits after such contact are marked."""
    contact = events.filter(F.col("stage").isin("contact", "lure"))
    c = F.col("details.contacts")
    idents = F.concat(F.array(F.col("sender.identifier"), F.col("details.domain")), *[F.coalesce(c[n], F.array().cast("array<string>")) for n in ("upi_ids", "phone_numbers", "emails")])
    suspects = contact.select("case_id", F.col("evidence_id").alias("suspect_id"), F.explode(F.transform(idents, F.lower)).alias("ident")).filter(F.col("ident") != "").distinct()
    key = ["case_id", "rec_ord", "sub_ord"]
    credit = F.coalesce(F.col("amount.direction") == "credit", F.lit(False))
    other = F.when(credit, F.col("sender")).otherwise(F.col("receiver"))
    payments = events.filter(F.col("stage") == "transaction").select(*key, "evidence_id", F.lower(other["identifier"]).alias("ident")).filter(F.col("ident") != "")
    linked = payments.join(suspects, ["case_id", "ident"]).filter(~F.col("suspect_id").eqNullSafe(F.col("evidence_id")))
    linked = linked.groupBy(*key).agg(F.sort_array(F.collect_set("suspect_id")).alias("linked_evidence"))
    first = contact.groupBy("case_id").agg(F.min("at.utc").alias("first_contact"))
    df = events.join(linked, key, "left").join(first, "case_id", "left")
    hit = F.coalesce(F.size("linked_evidence") > 0, F.lit(False))
    kind = F.when(~hit, F.col("event_type")).when(credit, "scammer_credit").when(F.col("event_type") == "failed_transaction", "fraud_attempt").otherwise("fraudulent_payment")
    label = F.when(kind == "fraud_attempt", "Fraud attempt: ").otherwise("Fraudulent payment: ")
    title = F.when(~hit, F.col("title")).when(credit, F.concat("title", F.lit(" (suspect account)"))).otherwise(F.concat(label, F.col("title")))
    description = F.when(hit, F.concat("description", F.lit(" — counterparty "), F.coalesce(party_label(other), F.lit("None")), F.lit(" appears in suspicious evidence"))).otherwise(F.col("description"))
    follows = (F.col("stage") == "transaction") & ~hit & ~credit & F.coalesce(F.col("first_contact") <= F.col("at.utc"), F.lit(False))
    return df.withColumns({
        "title": title, "description": description, "event_type": kind, "stage": F.when(hit & ~credit, "fraud").otherwise(F.col("stage")),
        "linked_evidence": F.coalesce("linked_evidence", F.array().cast("array<string>")), "follows": follows,
        "severity": F.when(follows, "medium").otherwise(_table(kind, SEVERITIES)),
    }).drop("first_contact")


def build_timeline(records: DataFrame, zone: str = DEFAULT_ZONE) -> tuple[DataFrame, DataFrame]:
    """Events (columns of EVENTS) in order within each case, and a summary row for each case."""
    events = events_of(records).withColumn("at", resolve(F.col("iso"), F.col("time_source"), zone, F.col("has_time")))
    events = _link(events)
    # undated last; a date without a time is the end of its day; then stages, then the input's order
    end = F.when(F.col("at.precision") == "date", F.expr("at.utc + INTERVAL '1' DAY - INTERVAL '1' MICROSECOND")).otherwise(F.col("at.utc"))
    events = events.withColumns({"undated": F.col("at.utc").isNull(), "sort_at": end, "stage_rank": _table(F.col("stage"), STAGES)})
    order = W.partitionBy("case_id").orderBy("undated", "sort_at", "stage_rank", "rec_ord", "sub_ord")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    precise = F.when(F.col("at.precision") == "datetime", F.unix_micros("at.utc"))
    events = events.withColumns({"sequence": F.row_number().over(order), "after_fraud": F.coalesce(F.max(F.col("stage") == "fraud").over(before), F.lit(False)), "last_precise": F.last(precise, ignorenulls=True).over(before)})
    follow = F.col("after_fraud") & (F.col("event_type") == "suspicious_message")
    events = events.withColumns({
        "title": F.when(follow, F.regexp_replace("title", "^(.*?)Suspicious", "$1Follow-up")).otherwise(F.col("title")),
        "severity": F.when(follow, SEVERITIES["follow_up_message"]).otherwise(F.col("severity")),
        "stage": F.when(follow, "follow_up").otherwise(F.col("stage")), "event_type": F.when(follow, "follow_up_message").otherwise(F.col("event_type")),
        "since_previous": humanize(F.floor((precise - F.col("last_precise")) / 1_000_000)),
    })
    out = events.select(
        "case_id", "sequence", "event_type", "stage", "title", "description", "evidence_id", "evidence_type", F.col("at.text").alias("timestamp"), F.col("at.precision").alias("time_precision"), "severity",
        F.struct(F.col("sender").alias("from"), F.col("receiver").alias("to")).alias("actors"), "amount", "url", F.coalesce("indicators", F.array().cast("array<string>")).alias("indicators"), "linked_evidence",
        F.col("details").withField("follows_suspicious_contact", F.when(F.col("follows"), True)).alias("details"), "since_previous", F.col("at.utc").alias("utc"),
    )
    return out.drop("utc"), _summary(out, records)


def _summary(events: DataFrame, records: DataFrame) -> DataFrame:
    dated, seq = F.col("utc").isNotNull(), F.col("sequence")
    losing = F.col("event_type") == "fraudulent_payment"
    is_contact = F.col("stage").isin("contact", "lure")
    suspect = F.when(F.col("stage") == "fraud", F.col("actors.to.identifier")).when(F.col("stage").isin("contact", "lure", "follow_up"), F.col("actors.from.identifier"))
    first = lambda v, when: F.min_by(v, F.when(when, seq))
    label = F.when(dated & ~F.col("event_type").isin("message", "url"), _table(F.col("event_type"), LABELS))
    row = events.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.count(F.when(~dated, 1)).alias("undated_event_count"),
        first("timestamp", dated).alias("first_event_at"), F.max_by("timestamp", F.when(dated, seq)).alias("last_event_at"),
        first("utc", dated).alias("t0"), F.max_by("utc", F.when(dated, seq)).alias("t1"), F.count(F.when(dated, 1)).alias("n_dated"),
        first("utc", dated & is_contact).alias("t_contact"), first("utc", dated & losing).alias("t_loss"),
        F.collect_set("stage").alias("stages"), F.count(F.when(losing, 1)).alias("fraudulent_payment_count"),
        F.sort_array(F.collect_set(F.when(suspect != "", suspect))).alias("suspect_identifiers"), F.max_by("severity", _table(F.col("severity"), SEVERITY_RANK)).alias("highest_severity"),
    )
    chain = events.withColumn("label", label).filter("label IS NOT NULL").groupBy("case_id", "label").agg(F.min("sequence").alias("at"))
    chain = chain.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), " → ").alias("attack_chain"))
    paid = events.filter(losing & F.col("amount.value").isNotNull() & (F.col("amount.value") != 0))
    loss = paid.groupBy("case_id", F.coalesce(F.when(F.col("amount.currency") != "", F.col("amount.currency")), F.lit("INR")).alias("currency")).agg(F.round(F.sum("amount.value"), 2).alias("loss"))
    loss = loss.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("currency", "loss")))).alias("total_loss"))
    counts = records.groupBy("case_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    seconds = lambda a, b: F.unix_seconds(b) - F.unix_seconds(a)
    s = counts.join(row, "case_id", "left").join(chain, "case_id", "left").join(loss, "case_id", "left")
    return s.select(
        "case_id", "evidence_count", F.coalesce("event_count", F.lit(0)).alias("event_count"), F.coalesce("undated_event_count", F.lit(0)).alias("undated_event_count"), "first_event_at", "last_event_at",
        F.when(F.col("n_dated") > 1, humanize(seconds(F.col("t0"), F.col("t1")))).alias("duration"), "attack_chain",
        F.filter(F.array(*map(F.lit, STAGES)), lambda x: F.array_contains(F.coalesce("stages", F.array().cast("array<string>")), x)).alias("stages_observed"),
        F.coalesce("fraudulent_payment_count", F.lit(0)).alias("fraudulent_payment_count"), F.coalesce("total_loss", F.create_map().cast("map<string,double>")).alias("total_loss"),
        F.when(F.col("t_loss") >= F.col("t_contact"), humanize(seconds(F.col("t_contact"), F.col("t_loss")))).alias("time_to_first_loss"),
        F.coalesce("suspect_identifiers", F.array().cast("array<string>")).alias("suspect_identifiers"), "highest_severity",
    )
