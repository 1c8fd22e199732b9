"""Gaps, contradictions and duplicates in a timeline (M4).

Checks of single events are one pass; the others are aggregations and equi-joins by case, reference, party or
evidence id. Comparisons with every linked message are conditions of a join followed by an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions.parties import format_money, identifier_key, name_key, party_label, reference_key
from siftline.operators.timeline import FAILED_STATUSES

SEVERITIES = ["low", "medium", "high"]
CATEGORIES = ["contradiction", "gap", "duplicate"]
SUCCEEDED = ["success", "successful", "completed", "processed", "paid", "debited", "credited"]
TOLERANCE_S = 3600
_VALUE = "struct<sequence:int,evidence_id:string,value:string>"
ISSUE = f"struct<category:string,issue_type:string,severity:string,title:string,description:string,field:string,events:array<int>,evidence_ids:array<string>,values:array<{_VALUE}>,suggestion:string>"
_COLUMNS = ["category", "issue_type", "severity", "title", "description", "field", "events", "evidence_ids", "values", "suggestion"]


def _text(x) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _issue(category, kind, severity, title, description, suggestion, field=None, events=None, evidence=None, values=None) -> Column:
    nothing = F.array()
    cells = [category, kind, severity, title, description, field, events if events is not None else nothing, evidence if evidence is not None else nothing, values if values is not None else nothing, suggestion]
    return F.struct(*[(F.lit(None) if c is None else _text(c)).alias(n) for n, c in zip(_COLUMNS, cells)]).cast(ISSUE)


def _with_keys(events: DataFrame) -> DataFrame:
    day = F.to_date(F.substring("timestamp", 1, 10))
    money = F.col("stage").isin("transaction", "fraud") & F.col("amount").isNotNull()
    status = F.lower(F.coalesce("details.status", F.lit("")))
    return events.withColumns({
        "t": F.when(F.col("time_precision") == "datetime", F.try_to_timestamp("timestamp")), "day": day, "is_money": money, "money": format_money(F.col("amount.value"), F.col("amount.currency")),
        "status_class": F.when(status.isin(FAILED_STATUSES), "failed").when(status.isin(SUCCEEDED), "succeeded"), "ref": F.when(money, reference_key(F.col("details.transaction_id"))),
        "own_id": F.when(F.col("evidence_id") != "", F.col("evidence_id")),
    })


def _single(e: DataFrame) -> DataFrame:
    """Issues of one event each: check_ord, emit_ord, issue."""
    where = {"events": F.array("sequence"), "evidence": F.filter(F.array("own_id"), lambda x: x.isNotNull())}
    title, fraud = F.col("title"), F.col("stage") == "fraud"
    debit = F.coalesce(F.when(F.col("amount.direction") != "", F.col("amount.direction")), F.lit("debit")) == "debit"
    payee = F.when(debit, "payee").otherwise("payer")
    party = F.when(debit, identifier_key(F.col("actors.to"))).otherwise(identifier_key(F.col("actors.from")))
    sender = F.col("actors.from")
    name = F.when(sender["name"] != "", sender["name"])
    known = F.when(name.isNotNull(), F.concat(F.lit('The sender is known only by the display name "'), name, F.lit('"'))).otherwise("The sender of this suspicious message is unknown")
    has_ref = F.coalesce(F.col("details.transaction_id"), F.lit("")) != ""
    found = [
        (2, F.col("is_money") & (F.col("time_precision") == "date"), _issue("gap", "date_only_timestamp", "low", F.concat(F.lit("Time of day unknown: "), title), F.concat(F.lit("Only the date ("), F.col("timestamp"), F.lit(") is known, so its order relative to messages the same day is inferred, not proven.")), "Get the payment receipt or UPI app history, which shows the exact time.", "timestamp", **where)),
        (3, F.col("is_money") & F.col("amount.value").isNull(), _issue("gap", "missing_amount", F.when(fraud, "high").otherwise("medium"), F.concat(F.lit("Amount missing: "), title), "The transaction amount could not be read, so the loss cannot be quantified.", "Get a clearer receipt or the bank statement entry.", "amount.value", **where)),
        (3, F.col("is_money") & party.isNull(), _issue("gap", "missing_counterparty", "medium", F.concat(F.lit("No "), payee, F.lit(" account: "), title), F.concat(F.lit("The "), payee, F.lit("'s UPI ID, account or phone number is missing, so this transaction cannot be linked to a suspect.")), F.concat(F.lit("Find the "), payee, F.lit(" VPA/account in the receipt or the UPI app history.")), F.when(debit, "actors.to.identifier").otherwise("actors.from.identifier"), **where)),
        (3, F.col("is_money") & ~has_ref, _issue("gap", "missing_transaction_id", F.when(fraud, "medium").otherwise("low"), F.concat(F.lit("No UTR/reference: "), title), "Without a UTR or transaction reference the bank cannot trace or freeze this payment.", "Get the UTR number from the receipt, SMS alert or bank statement.", "details.transaction_id", **where)),
        (4, F.col("event_type").isin("suspicious_message", "follow_up_message") & (F.coalesce(sender["identifier"], F.lit("")) == ""), _issue("gap", "missing_sender_id", "medium", F.concat(F.lit("Sender not identified: "), title), F.concat(known, F.lit(", so it cannot be traced or matched with other evidence.")), "Get the sender's phone number, email address or SMS header (e.g. from the chat's contact info).", "actors.from.identifier", **where)),
        (5, F.coalesce(F.col("details.follows_suspicious_contact"), F.lit(False)), _issue("gap", "unlinked_debit", "medium", F.concat(F.lit("Possible loss not linked to the scam: "), title), "This debit happened after suspicious contact, but its payee does not appear in any suspicious evidence, so it may or may not be part of the fraud.", "Ask the victim whether they made this payment and why; collect the message that gave them the payee details.", "actors.to", **where)),
    ]
    cells = F.array(*[F.when(test, F.struct(F.lit(n).alias("check_ord"), (F.col("sequence") * 10 + i).alias("emit_ord"), issue.alias("issue"))) for i, (n, test, issue) in enumerate(found)])
    return e.select("case_id", F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x")).select("case_id", "x.*")


def _packed(df: DataFrame, check: int, emit: Column, issue: Column) -> DataFrame:
    return df.select("case_id", F.lit(check).alias("check_ord"), emit.cast("int").alias("emit_ord"), issue.alias("issue"))


def _ids(col: str | Column) -> Column:
    return F.sort_array(F.collect_set(col))


def _undated(e: DataFrame) -> DataFrame:
    group = e.filter("timestamp IS NULL").groupBy("case_id", F.coalesce("own_id", F.concat(F.lit("\x00"), F.col("sequence"))).alias("k")).agg(
        F.bool_or(F.col("stage").isin("transaction", "fraud")).alias("money"), F.min_by("title", "sequence").alias("title"), F.min("sequence").alias("at"), F.sort_array(F.collect_list("sequence")).alias("events"), _ids("own_id").alias("ids"),
    )
    text = F.concat(F.lit("This evidence has no date or time, so its place in the attack chain is unknown"), F.when(F.col("money"), " and the payment cannot be matched to a bank statement.").otherwise("."))
    issue = _issue("gap", "missing_timestamp", F.when(F.col("money"), "high").otherwise("medium"), F.concat(F.lit("No timestamp: "), F.col("title")), text, "Get the original with its date (full screenshot, message info, email headers or bank statement entry).", "timestamp", F.col("events"), F.col("ids"))
    return _packed(group, 1, F.col("at"), issue)


def _no_payments(e: DataFrame) -> DataFrame:
    case = e.groupBy("case_id").agg(F.bool_or(F.col("stage").isin("contact", "lure", "follow_up")).alias("contact"), F.bool_or("is_money").alias("money")).filter("contact AND NOT money")
    issue = _issue("gap", "no_transaction_evidence", "medium", "No transaction evidence", "The case has suspicious contact but no payment records, so any loss is unproven.", "Collect bank statements, UPI history or payment receipts for the period after the first contact (or confirm no money was lost).")
    return _packed(case, 6, F.lit(0), issue)


def _values(rows: Column, value) -> Column:
    return F.transform(rows, lambda r: F.struct(r["sequence"].alias("sequence"), r["own_id"].alias("evidence_id"), value(r).cast("string").alias("value")))


def _references(e: DataFrame) -> DataFrame:
    """Evidence of one payment reference has to agree; else each difference is a contradiction, and agreement a duplicate."""
    row = F.struct("sequence", F.col("evidence_id").alias("own_id"), F.col("amount.value").alias("value"), "money", F.col("amount.currency").alias("currency"), F.col("amount.direction").alias("direction"), party_label(F.col("actors.to")).alias("payee"), party_label(F.col("actors.from")).alias("payer"), F.col("details.status").alias("status"), "timestamp")
    filled = lambda c: F.when(c != "", c)
    g = e.filter("ref IS NOT NULL").groupBy("case_id", "ref").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.count(F.lit(1)).alias("n"), F.min("sequence").alias("at"), _ids("own_id").alias("ids"),
        F.size(F.collect_set(F.round("amount.value", 2))).alias("n_amounts"), _ids("money").alias("moneys"), _ids(filled(F.col("amount.currency"))).alias("currencies"), F.size(F.collect_set(filled(F.col("amount.direction")))).alias("n_directions"),
        F.collect_list(F.when(identifier_key(F.col("actors.to")).isNotNull(), F.struct("sequence", identifier_key(F.col("actors.to")).alias("k"), party_label(F.col("actors.to")).alias("l")))).alias("payees"),
        F.collect_list(F.when(identifier_key(F.col("actors.from")).isNotNull(), F.struct("sequence", identifier_key(F.col("actors.from")).alias("k"), party_label(F.col("actors.from")).alias("l")))).alias("payers"),
        F.size(F.collect_set("status_class")).alias("n_statuses"), F.size(F.collect_set("day")).alias("n_days"), (F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))).alias("spread"), _ids("timestamp").alias("times"),
        F.count(F.when(F.col("event_type") == "fraudulent_payment", 1)).alias("counted"),
    ).filter("n > 1")
    for c in ("payees", "payers"):  # the first label of each key
        g = g.withColumn(c, _firsts(F.col(c)))
    where = {"events": F.transform("rows", lambda r: r["sequence"]), "evidence": F.col("ids")}
    advice = "Check which record is authentic against the bank's own statement."
    name = lambda what: F.concat(F.lit(f"Conflicting {what} for transaction "), F.col("ref"))
    listed = lambda lead, items: F.concat(F.lit(lead), F.array_join(items, ", "), F.lit("."))
    labels = lambda c: F.sort_array(F.transform(c, lambda x: x["l"]))
    found = [
        (F.col("n_amounts") > 1, "amount_mismatch", "high", "amounts", "amount.value", lambda r: r["value"], listed("The same reference appears with different amounts: ", F.col("moneys"))),
        (F.size("currencies") > 1, "currency_mismatch", "medium", "currencies", "amount.currency", lambda r: r["currency"], listed("The same reference appears in different currencies: ", F.col("currencies"))),
        (F.col("n_directions") > 1, "direction_mismatch", "high", "directions", "amount.direction", lambda r: r["direction"], F.lit("One record shows this reference as a debit and another as a credit.")),
        (F.size("payees") > 1, "payee_mismatch", "high", "payees", "actors.to.identifier", lambda r: r["payee"], listed("The same reference names different payees: ", labels("payees"))),
        (F.size("payers") > 1, "payer_mismatch", "medium", "payers", "actors.from.identifier", lambda r: r["payer"], listed("The same reference names different payers: ", labels("payers"))),
        (F.col("n_statuses") > 1, "status_mismatch", "high", "statuses", "details.status", lambda r: r["status"], F.lit("One record shows this payment as failed and another as successful, which changes whether money was lost.")),
        ((F.col("n_days") > 1) | F.coalesce(F.col("spread") > TOLERANCE_S * 1_000_000, F.lit(False)), "timestamp_mismatch", "medium", "timestamps", "timestamp", lambda r: r["timestamp"], listed("The records disagree on when this payment happened: ", F.col("times"))),
    ]
    conflicts = F.filter(F.array(*[F.when(test, _issue("contradiction", kind, severity, name(what), text, advice, field, values=_values(F.col("rows"), value), **where)) for test, kind, severity, what, field, value, text in found]), lambda x: x.isNotNull())
    counted = F.when(F.col("counted") > 1, F.concat(F.lit("; the timeline's total loss counts it "), F.col("counted").cast("string"), F.lit(" times."))).otherwise(".")
    same = _issue("duplicate", "duplicate_transaction", F.when(F.col("counted") > 1, "medium").otherwise("low"), F.concat(F.lit("Same transaction in "), F.col("n").cast("string"), F.lit(" pieces of evidence (ref "), F.col("ref"), F.lit(")")), F.concat(F.lit("These records agree and describe one payment"), counted), "Count this payment once when reporting the loss.", "details.transaction_id", values=_values(F.col("rows"), lambda r: r["money"]), **where)
    rows = g.withColumn("issues", conflicts).withColumn("issues", F.when(F.size("issues") > 0, F.col("issues")).otherwise(F.array(same)))
    rows = rows.select("case_id", "at", F.posexplode("issues").alias("i", "issue"))
    return rows.select("case_id", F.lit(7).alias("check_ord"), (F.col("at") * 10 + F.col("i")).cast("int").alias("emit_ord"), "issue")


def _firsts(items: Column) -> Column:
    """Of items sorted by sequence, the first of each key."""
    return F.filter(items, lambda x: F.forall(items, lambda y: (y["k"] != x["k"]) | (y["sequence"] >= x["sequence"])))


def _asked_and_paid(e: DataFrame) -> DataFrame:
    """Payments that match no sum asked for in the messages they are linked with."""
    key = ["case_id", "sequence"]
    paid = e.filter(F.col("event_type").isin("fraudulent_payment", "fraud_attempt") & F.col("amount.value").isNotNull())
    paid = paid.select(*key, "own_id", "title", "money", F.col("amount.value").alias("paid"), F.coalesce(F.when(F.col("amount.currency") != "", F.col("amount.currency")), F.lit("INR")).alias("currency"), F.explode("linked_evidence").alias("link_id"))
    asking = e.filter(F.size("details.amounts_mentioned") > 0).select("case_id", F.col("own_id").alias("link_id"), F.col("sequence").alias("asked_at"), F.col("details.amounts_mentioned").alias("asked"))
    j = paid.join(asking, ["case_id", "link_id"])
    code = lambda a: F.coalesce(F.when(a["currency"] != "", a["currency"]), F.lit("INR"))
    mine = F.filter("asked", lambda a: (code(a) == F.col("currency")) & a["value"].isNotNull())
    j = j.withColumn("mine", mine)
    g = j.groupBy(*key, "own_id", "title", "money", "paid").agg(
        F.sort_array(F.collect_list(F.struct("link_id", "asked_at", F.to_json(F.transform("asked", lambda a: a["value"])).alias("values")))).alias("links"),
        F.flatten(F.collect_list("mine")).alias("mine"),
    )
    g = g.filter((F.size("mine") > 0) & ~F.exists("mine", lambda a: F.abs(a["value"] - F.col("paid")) < 0.01))
    asked = F.array_join(F.sort_array(F.array_distinct(F.transform("mine", lambda a: format_money(a["value"], a["currency"])))), " / ")
    many = F.when(F.size("links") > 1, "s").otherwise("")
    events = F.sort_array(F.concat(F.array("sequence"), F.transform("links", lambda x: x["asked_at"])))
    ids = F.sort_array(F.array_distinct(F.filter(F.concat(F.array("own_id"), F.transform("links", lambda x: x["link_id"])), lambda x: x.isNotNull())))
    values = F.concat(F.array(F.struct("sequence", F.col("own_id").alias("evidence_id"), F.col("paid").cast("string").alias("value"))), F.transform("links", lambda x: F.struct(x["asked_at"].alias("sequence"), x["link_id"].alias("evidence_id"), x["values"].alias("value"))))
    text = F.concat(F.lit("The linked message"), many, F.lit(" asked for "), asked, F.lit(", but the payment was "), F.col("money"), F.lit("."))
    issue = _issue("contradiction", "requested_amount_mismatch", "medium", F.concat(F.lit("Paid amount differs from the amount requested: "), F.col("title")), text, "Check for further payments (split instalments, fees) or a misread amount.", "amount.value", events, ids, values)
    return _packed(g, 8, F.col("sequence"), issue)


def _names(e: DataFrame) -> DataFrame:
    """One name with several identifiers, one identifier with several names."""
    roles = F.array(F.struct(F.lit(0).alias("role"), F.col("actors.from").alias("p")), F.struct(F.lit(1).alias("role"), F.col("actors.to").alias("p")))
    p = e.select("case_id", "sequence", "own_id", F.explode(roles).alias("x")).select("case_id", "sequence", "own_id", "x.role", name_key(F.col("x.p")).alias("name"), identifier_key(F.col("x.p")).alias("ident"), F.col("x.p.name").alias("shown_name"), F.col("x.p.identifier").alias("shown_ident"))
    p = p.filter("name IS NOT NULL AND ident IS NOT NULL")

    def conflicts(by: str, other: str, shown_by: str, shown: str):
        # hits in the order of the other key's first appearance
        first = F.min(F.struct("sequence", "role")).over(W.partitionBy("case_id", by, other))
        q = p.withColumn("first", first)
        g = q.groupBy("case_id", by).agg(F.size(F.collect_set(other)).alias("n"), F.array_sort(F.collect_list(F.struct("first", "sequence", "role", "own_id", shown_by, shown, other))).alias("hits")).filter("n > 1")
        heads = F.filter("hits", lambda h: (h["first"]["sequence"] == h["sequence"]) & (h["first"]["role"] == h["role"]))
        listed = F.array_join(F.sort_array(F.array_distinct(F.transform(heads, lambda h: h[shown]))), ", ")
        return g.withColumns({"listed": listed, "who": F.get("hits", F.lit(0))[shown_by], "at": F.get("hits", F.lit(0))["sequence"], "events": F.sort_array(F.array_distinct(F.transform("hits", lambda h: h["sequence"]))), "ids": F.sort_array(F.array_distinct(F.filter(F.transform("hits", lambda h: h["own_id"]), lambda x: x.isNotNull()))), "vals": _values(F.col("hits"), lambda h: h[shown])})

    a = conflicts("name", "ident", "shown_name", "shown_ident")
    one = _issue("contradiction", "sender_id_conflict", "medium", F.concat(F.lit('"'), F.col("who"), F.lit('" appears with '), F.col("n").cast("string"), F.lit(" different identifiers")), F.concat(F.lit("The same name is linked to "), F.col("listed"), F.lit(". Either the suspect uses several accounts, or the evidence is attributed to the wrong party.")), "Record every identifier as a suspect account and confirm with the victim which contact they dealt with.", "actors.identifier", F.col("events"), F.col("ids"), F.col("vals"))
    b = conflicts("ident", "name", "shown_ident", "shown_name")
    two = _issue("contradiction", "identifier_name_conflict", "low", F.concat(F.col("who"), F.lit(" appears under "), F.col("n").cast("string"), F.lit(" different names")), F.concat(F.lit("The same identifier uses the names "), F.col("listed"), F.lit(", a common impersonation pattern (or a contact saved under different names).")), None, "actors.name", F.col("events"), F.col("ids"), F.col("vals"))
    return _packed(a, 9, F.col("at"), one).unionByName(_packed(b, 10, F.col("at"), two))


def _too_early(e: DataFrame) -> DataFrame:
    """Payments earlier than every linked contact."""
    paid = e.filter(F.col("event_type").isin("fraudulent_payment", "fraud_attempt") & F.col("timestamp").isNotNull()).select("case_id", "sequence", "own_id", "title", "timestamp", "t", "day", F.explode("linked_evidence").alias("link_id"))
    c = e.filter(F.col("stage").isin("contact", "lure", "follow_up") & F.col("timestamp").isNotNull()).select("case_id", F.col("own_id").alias("link_id"), F.col("sequence").alias("c_seq"), F.col("timestamp").alias("c_time"), F.col("t").alias("c_t"), F.col("day").alias("c_day"))
    j = paid.join(c, ["case_id", "link_id"])
    before = F.when(F.col("t").isNotNull() & F.col("c_t").isNotNull(), F.col("t") < F.col("c_t")).otherwise(F.col("day") < F.col("c_day"))
    g = j.groupBy("case_id", "sequence", "own_id", "title", "timestamp").agg(F.bool_and(before).alias("all_before"), F.array_sort(F.collect_list(F.struct("link_id", "c_seq", "c_time"))).alias("links")).filter("all_before")
    times = F.array_join(F.sort_array(F.array_distinct(F.transform("links", lambda x: x["c_time"]))), ", ")
    events = F.sort_array(F.concat(F.array("sequence"), F.transform("links", lambda x: x["c_seq"])))
    ids = F.sort_array(F.array_distinct(F.filter(F.concat(F.array("own_id"), F.transform("links", lambda x: x["link_id"])), lambda x: x.isNotNull())))
    values = F.concat(F.array(F.struct("sequence", F.col("own_id").alias("evidence_id"), F.col("timestamp").alias("value"))), F.transform("links", lambda x: F.struct(x["c_seq"].alias("sequence"), x["link_id"].alias("evidence_id"), x["c_time"].alias("value"))))
    text = F.concat(F.lit("The payment ("), F.col("timestamp"), F.lit(") is earlier than every linked message ("), times, F.lit("). A timestamp may be wrong (e.g. a timezone or day/month mix-up), or earlier contact is missing."))
    issue = _issue("contradiction", "payment_before_contact", "medium", F.concat(F.lit("Payment dated before the contact that led to it: "), F.col("title")), text, "Verify both timestamps and ask for any earlier messages from this contact.", "timestamp", events, ids, values)
    return _packed(g, 11, F.col("sequence"), issue)


def check(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issues of each case, numbered by severity, category, first event and type; and a summary row for each case."""
    e = _with_keys(events)
    found = [_single(e), _undated(e), _no_payments(e), _references(e), _asked_and_paid(e), _names(e), _too_early(e)]
    issues = found[0]
    for f in found[1:]:
        issues = issues.unionByName(f)
    rank = lambda values, c: F.array_position(F.array(*map(F.lit, values)), c)
    order = W.partitionBy("case_id").orderBy(F.desc(rank(SEVERITIES, F.col("issue.severity"))), rank(CATEGORIES, F.col("issue.category")), F.coalesce(F.get("issue.events", F.lit(0)), F.lit(0)), "issue.issue_type", "check_ord", "emit_ord", "issue.title")
    numbered = issues.withColumn("n", F.row_number().over(order)).select("case_id", "n", F.format_string("ISSUE-%03d", "n").alias("issue_id"), "issue.*")
    counts = lambda col, values: F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.count(F.when(F.col(col) == v, 1)) for v in values]))
    cases = events.groupBy("case_id").agg(F.count(F.lit(1)).alias("events_checked"))
    zero = lambda values: F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.lit(0).cast("long")] * len(values)))
    down = SEVERITIES[::-1]
    s = numbered.groupBy("case_id").agg(F.count(F.lit(1)).alias("issue_count"), counts("category", CATEGORIES).alias("by_category"), counts("severity", down).alias("by_severity"), F.min_by("severity", "n").alias("highest_severity"))
    s = cases.join(s, "case_id", "left").select("case_id", "events_checked", F.coalesce("issue_count", F.lit(0)).alias("issue_count"), F.coalesce("by_category", zero(CATEGORIES)).alias("by_category"), F.coalesce("by_severity", zero(down)).alias("by_severity"), "highest_severity")
    return numbered, s
