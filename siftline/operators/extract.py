"""Evidence to key-field records (M2): sender, receiver, time, payments, links with reputation, message, contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.dates import TEXT_DATETIME, parse_datetime
from siftline.functions.parties import PARTY, SMS_HEADER, make_party
from siftline.functions.text import refang, strip, upi_ids
from siftline.functions.urls import reputations

SCHEMA_VERSION = "1.0"
HEADER = r"(?imdU)^(from|to|date|subject|sent|received)\s*:\s*(.+)$"
CHAT_LINE = r"(?U)^\[?(\d{1,2}/\d{1,2}/\d{2,4}),?\s+(\d{1,2}:\d{2}(?::\d{2})?(?:\s?[AaPp]\.?[Mm]\.?)?)\]?\s*(?:-\s*)?([^:\n]{1,60}?):\s(.*)$"
_SMS_START = r"\A" + SMS_HEADER.removeprefix("(?m)^")


def _header(name: str) -> Column:
    """The last header of a name, as found in `headers`."""
    own = F.filter("headers", lambda h: h["name"] == name)
    return F.when(F.size(own) > 0, F.element_at(own, -1)["value"])


def _pick(*options: tuple[Column, str]) -> Column:
    """The first option that isn't null, with its source."""
    return F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(s).alias("source"))) for v, s in options])


def _payment(txn: Column, has_time: bool = True) -> Column:
    """A payment with parties; a UPI id in the narration stands in for a missing counterparty. has_time: whether txn has that field."""
    upi = F.get(upi_ids(refang(F.coalesce(txn["description"], F.lit("")))), F.lit(0))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    credit = F.coalesce(txn["direction"] == "credit", F.lit(False))
    sender = F.when(credit & blank(txn["sender"]), F.coalesce(upi, txn["sender"])).otherwise(txn["sender"])
    receiver = F.when(~credit & blank(txn["receiver"]), F.coalesce(upi, txn["receiver"])).otherwise(txn["receiver"])
    return F.struct(
        *[txn[n].alias(n) for n in ("transaction_id", "amount", "currency", "direction", "payment_method", "status")],
        make_party(sender).alias("sender"), make_party(receiver).alias("receiver"),
        F.coalesce(parse_datetime(txn["timestamp"]), txn["timestamp"]).alias("timestamp"), txn["description"].alias("description"),
        (txn["has_time"] if has_time else F.lit(None).cast("boolean")).alias("has_time"),
    )


def _totals(first: Column, txns: Column) -> Column:
    """The first payment's fields, and sums over a statement of several."""
    total = lambda d: F.round(F.aggregate(F.filter(txns, lambda t: t["direction"] == d), F.lit(0.0), lambda a, t: a + F.coalesce(t["amount"], F.lit(0.0))), 2)
    many = F.size(txns) > 1
    return F.struct(
        *[first[n].alias(n) for n in ("transaction_id", "amount", "currency", "direction", "payment_method", "status")],
        F.when(many, F.size(txns)).alias("record_count"), F.when(many, total("debit")).alias("total_debit"),
        F.when(many, total("credit")).alias("total_credit"), F.when(many, F.array_max(F.transform(txns, lambda t: t["amount"]))).alias("max_amount"),
    )


def extract(evidence: DataFrame, block: list[str] = (), allow: list[str] = ()) -> DataFrame:
    """Records of evidence rows. block and allow are lists of domains for the links' reputation."""
    kind = F.col("evidence_type")
    texty = kind.isin("message", "screenshot")
    text = F.when(texty, F.col("normalized_text"))
    names, values = F.regexp_extract_all(text, F.lit(HEADER), F.lit(1)), F.regexp_extract_all(text, F.lit(HEADER), F.lit(2))
    df = evidence.withColumn("headers", F.zip_with(names, values, lambda n, v: F.struct(F.lower(n).alias("name"), F.trim(v).alias("value"))))
    has_from = F.coalesce(_header("from").isNotNull(), F.lit(False))
    body = F.when(has_from, strip(F.regexp_replace(text, HEADER, ""))).otherwise(text)
    df = df.withColumns({"has_from": has_from, "body": body, "h_from": _header("from"), "h_to": _header("to"), "h_date": F.coalesce(_header("date"), _header("sent")), "subject": _header("subject")})
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(CHAT_LINE))
    part = lambda x, i: F.regexp_extract(x, CHAT_LINE, i)
    df = df.withColumn("chat", F.transform(lines, lambda x: F.struct(F.concat_ws(" ", part(x, 1), part(x, 2)).alias("time"), F.trim(part(x, 3)).alias("name"), part(x, 4).alias("text"))))
    is_chat = F.coalesce(F.size("chat") > 0, F.lit(False))
    df = df.withColumn("is_chat", is_chat).withColumn("participants", F.when(F.col("is_chat"), F.array_distinct(F.transform("chat", lambda c: c["name"]))).otherwise(F.array().cast("array<string>")))
    platform = F.when(F.col("has_from"), F.when(F.col("subject").isNotNull() | F.col("h_from").contains("@"), "email").otherwise("sms")).when(F.col("is_chat"), "chat")
    sms_id = F.when(texty & platform.isNull() & F.col("body").rlike(_SMS_START), F.regexp_extract("body", _SMS_START, 1))
    df = df.withColumns({"platform": F.coalesce(platform, F.when(sms_id.isNotNull(), "sms")), "sms_id": sms_id})
    content = F.when(F.col("is_chat"), F.array_join(F.transform("chat", lambda c: F.concat_ws(": ", c["name"], c["text"])), "\n")).when(F.col("sms_id").isNotNull(), strip(F.regexp_replace("body", _SMS_START, ""))).otherwise(F.col("body"))
    df = df.withColumn("content", content)

    raw_txns = F.when(kind == "transaction", F.col("transactions")).when(F.col("ocr.transaction").isNotNull(), F.array("ocr.transaction"))
    flagged = "has_time" in evidence.schema["transactions"].dataType.elementType.names  # evidence of older stores isn't
    df = df.withColumn("txns", F.transform(raw_txns, lambda t: _payment(t, flagged)))
    first = F.get("txns", F.lit(0))
    none = F.lit(None).cast("string")
    chat_party = lambda i: F.when(F.size("participants") > i, make_party(none, F.get("participants", F.lit(i))))
    sms_party = F.when(F.col("sms_id").isNotNull(), F.struct(none.alias("name"), F.col("sms_id").alias("identifier"), F.lit("sms_sender_id").alias("identifier_type"), F.col("sms_id").alias("raw"))).cast(PARTY)
    meta = lambda k: F.when(F.try_element_at("metadata", F.lit(k)) != "", F.try_element_at("metadata", F.lit(k)))
    text_time = F.when(texty, F.regexp_extract("content", TEXT_DATETIME, 1))
    meta_time = parse_datetime(meta("timestamp"))
    from_header = F.when(F.col("has_from"), make_party(F.col("h_from")))
    to_header = F.when(F.col("has_from"), make_party(F.col("h_to")))
    header_time = F.when(F.col("has_from"), parse_datetime(F.col("h_date")))
    chat_time = F.when(F.col("is_chat"), parse_datetime(F.get("chat", F.lit(0))["time"]))
    df = df.withColumns({
        "sender_of": _pick((make_party(meta("sender")), "metadata"), (chat_party(0), "chat_export"), (sms_party, "sms_header"), (from_header, "header"), (first["sender"], "transaction")),
        "receiver_of": _pick((make_party(meta("receiver")), "metadata"), (chat_party(1), "chat_export"), (to_header, "header"), (first["receiver"], "transaction")),
        "time_of": _pick((meta_time, "metadata"), (chat_time, "chat_export"), (header_time, "header"), (parse_datetime(F.when(text_time != "", text_time)), "text"), (first["timestamp"], "transaction")),
    })
    df = df.withColumn("urls", reputations(F.col("url_infos"), list(block), list(allow)))
    transaction = F.when(F.size("txns") > 0, _totals(first, F.col("txns")))
    sources = F.filter(F.array(
        F.struct(F.lit("sender").alias("key"), F.col("sender_of.source").alias("value")), F.struct(F.lit("receiver").alias("key"), F.col("receiver_of.source").alias("value")),
        F.struct(F.lit("timestamp").alias("key"), F.col("time_of.source").alias("value")), F.struct(F.lit("transaction").alias("key"), F.when(F.size("txns") > 0, "transaction").alias("value")),
        F.struct(F.lit("urls").alias("key"), F.when(kind == "url", "evidence_url").when(F.size("urls") > 0, "text").alias("value")),
    ), lambda e: e["value"].isNotNull())
    bad_time = F.when(meta("timestamp").isNotNull() & meta_time.isNull(), F.concat(F.lit("unparseable metadata timestamp: '"), meta("timestamp"), F.lit("'")))
    message = F.when(texty, F.struct(
        F.col("content").alias("content"), F.col("subject").alias("subject"), F.col("platform").alias("platform"), F.col("participants").alias("participants"),
        F.length("content").alias("char_count"), F.col("entities.amounts").alias("amounts_mentioned"), F.col("ocr.confidence").alias("ocr_confidence"),
    ))
    return df.select(
        "case_id", "rec_ord", F.lit(SCHEMA_VERSION).alias("schema_version"), "evidence_id", "evidence_type", "source", "content_hash",
        F.col("sender_of.value").alias("sender"), F.col("receiver_of.value").alias("receiver"), F.col("time_of.value").alias("timestamp"), transaction.alias("transaction"),
        F.coalesce("txns", F.array().cast(df.schema["txns"].dataType)).alias("transactions"), "urls", message.alias("message"),
        F.struct(*[F.col(f"entities.{n}").alias(n) for n in ("phone_numbers", "emails", "upi_ids", "reference_numbers")]).alias("contacts"),
        F.map_from_entries(sources).alias("field_sources"), F.concat("warnings", F.filter(F.array(bad_time), lambda w: w.isNotNull())).alias("warnings"),
    )
