"""Payment records: any column names to ten fields, and alerts in plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import once
from siftline.functions.dates import TEXT_DATE, parse_timestamp
from siftline.functions.text import CURRENCIES, amounts, lookup, parse_amount, reference_numbers, refang, upi_ids

# What columns of payment records are called, words of alerts, and their patterns.
ALIASES = {
    "transaction_id": ["transaction_id", "txn_id", "txnid", "id", "utr", "rrn", "reference", "reference_number", "ref_no", "ref"],
    "timestamp": ["timestamp", "date", "datetime", "time", "txn_date", "transaction_date", "value_date", "created_at"],
    "amount": ["amount", "amt", "value", "txn_amount", "transaction_amount", "debit", "credit", "withdrawal", "deposit"],
    "currency": ["currency", "cur", "ccy"],
    "direction": ["direction", "type", "dr_cr", "cr_dr", "txn_type"],
    "sender": ["sender", "from", "payer", "from_account", "remitter", "source"],
    "receiver": ["receiver", "to", "payee", "beneficiary", "to_account", "vpa", "merchant", "destination"],
    "payment_method": ["payment_method", "method", "mode", "channel", "payment_mode"],
    "status": ["status", "state", "result"],
    "description": ["description", "narration", "remarks", "note", "memo", "particulars", "details"],
}
DEBIT_WORDS = ["dr", "debit", "debited", "withdrawal", "sent", "out", "outgoing", "paid"]
CREDIT_WORDS = ["cr", "credit", "credited", "deposit", "received", "in", "incoming"]
SPLIT_AMOUNTS = ["debit", "withdrawal", "credit", "deposit"]
KEYWORDS = r"(?iU)\b(debited|credited|debit|credit|withdrawn|deposited|sent|received|paid|a/c|acct|account|upi|imps|neft|rtgs|utr|txn|transaction)\b"
_DIRECTION = r"(?iU)\b(debited|withdrawn|sent|paid|dr)\b|\b(credited|deposited|received|cr)\b"
_METHOD = r"(?iU)\b(upi|imps|neft|rtgs|card|atm|net ?banking|wallet)\b"
_ACCOUNT = r"(?iU)\ba/?c\.?\s*(?:no\.?)?\s*([x*]*\d{3,6})"

TXN = "struct<transaction_id:string,timestamp:string,amount:double,amount_raw:string,currency:string,direction:string,sender:string,receiver:string,payment_method:string,status:string,description:string,extra:map<string,string>,has_time:boolean>"
FIELDS = ["transaction_id", "timestamp", "amount", "amount_raw", "currency", "direction", "sender", "receiver", "payment_method", "status", "description", "extra", "has_time"]


def normal_key(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def normal_direction(col: Column) -> Column:
    text = F.lower(F.trim(col))
    return F.when(text.isin(DEBIT_WORDS), "debit").when(text.isin(CREDIT_WORDS), "credit")


def looks_like_alert(text: Column) -> Column:
    """Whether a text names a sum of money and two different words of banking."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(KEYWORDS), F.lit(1)), F.lower))
    return F.coalesce((F.size(words) >= 2) & (F.size(amounts(refang(text))) > 0), F.lit(False))


def _stages(records: Column, *steps) -> Column:
    for step in steps:
        records = F.transform(records, step)
    return records


def normalize_records(maps: Column) -> Column:
    """array<map> of raw records, keys in their order, as array<struct<txn, warnings>>.

    Of several columns of one field the first non-empty one counts; what isn't used is in `extra`. An amount
    that can't be read is null, with its text in amount_raw and a warning. has_time says whether the time is an
    ISO one with a T: its midnight was given, where others' may stand for a date.
    """
    alias = {a: field for field, names in ALIASES.items() for a in names}

    def named(m):
        def entry(e):
            key = normal_key(e["key"])
            return F.struct(e["key"].alias("key"), e["value"].alias("value"), key.alias("norm"), F.when(e["value"].isNotNull() & (e["value"] != ""), lookup(key, alias)).alias("field"))

        return F.struct(F.transform(F.map_entries(m), entry).alias("e"))

    def chosen(x):
        first = F.filter(x["e"], lambda a, i: a["field"].isNotNull() & ~F.exists(F.slice(x["e"], F.lit(1), i), lambda b: b["field"].eqNullSafe(a["field"])))
        rest = F.filter(x["e"], lambda a, i: a["field"].isNull() | F.exists(F.slice(x["e"], F.lit(1), i), lambda b: b["field"].eqNullSafe(a["field"])))
        split = F.filter(x["e"], lambda a: (a["field"] == "amount") & a["norm"].isin(SPLIT_AMOUNTS))
        # a debit or credit column says the direction, unless a direction stood before it
        says = F.filter(x["e"], lambda a: (a["field"] == "direction") | ((a["field"] == "amount") & a["norm"].isin(SPLIT_AMOUNTS)))
        lead = F.get(says, F.lit(0))
        direction = F.when(lead["field"] == "direction", lead["value"]).otherwise(normal_direction(lead["norm"]))
        return F.struct(F.map_from_entries(F.transform(first, lambda a: F.struct(a["field"].alias("key"), a["value"].alias("value")))).alias("v"), F.map_from_entries(F.transform(rest, lambda a: F.struct(a["key"].alias("key"), a["value"].alias("value")))).alias("extra"), direction.alias("direction"), (F.size(split) > 0).alias("split"))

    def numbers(x):
        raw = F.try_element_at(x["v"], F.lit("amount"))
        # the currency's name goes first: its dot isn't a decimal point
        bare = F.regexp_replace(F.regexp_replace(raw, r"(?i)₹|rs\.?|inr", ""), r"[^0-9.,-]", "")
        return F.struct(x["v"].alias("v"), x["extra"].alias("extra"), x["direction"].alias("direction"), raw.alias("raw"), F.coalesce(raw.try_cast("double"), parse_amount(bare)).alias("amount"), F.try_element_at(x["v"], F.lit("timestamp")).alias("ts"))

    def finish(x):
        get = lambda f: F.try_element_at(x["v"], F.lit(f))
        direction = F.coalesce(x["direction"], F.when(x["amount"] < 0, "debit"))
        parsed = parse_timestamp(x["ts"])
        txn = F.struct(
            F.trim(get("transaction_id")).alias("transaction_id"), F.coalesce(parsed, x["ts"]).alias("timestamp"),
            F.abs(x["amount"]).alias("amount"), F.when(x["amount"].isNull(), x["raw"]).alias("amount_raw"),
            F.upper(F.coalesce(get("currency"), F.when(x["raw"].rlike(r"(?i)₹|rs|inr"), "INR"))).alias("currency"),
            F.coalesce(normal_direction(direction), direction).alias("direction"), get("sender").alias("sender"), get("receiver").alias("receiver"),
            F.upper(get("payment_method")).alias("payment_method"), get("status").alias("status"), get("description").alias("description"),
            F.when(F.size(x["extra"]) > 0, x["extra"]).alias("extra"), F.when(parsed.isNotNull(), x["ts"].rlike(r"\dT\d")).alias("has_time"),
        )
        warn = F.array(
            F.when(x["raw"].isNotNull() & x["amount"].isNull(), F.concat(F.lit("unparseable amount: '"), x["raw"], F.lit("'"))),
            F.when(x["ts"].isNotNull() & parsed.isNull(), F.concat(F.lit("unparseable timestamp: '"), x["ts"], F.lit("'"))),
        )
        return F.struct(txn.cast(TXN).alias("txn"), F.filter(warn, lambda w: w.isNotNull()).alias("warnings"))

    return _stages(maps, named, chosen, numbers, finish)


def parse_alert(text: Column) -> Column:
    """The payment that a normalised alert text reports."""
    return once(text, _alert)


def _alert(text: Column) -> Column:
    clean = refang(text)
    money, ref, upi = F.get(amounts(clean), F.lit(0)), F.get(reference_numbers(clean), F.lit(0)), F.get(upi_ids(clean), F.lit(0))
    group = lambda p, i: F.when(F.regexp_extract(text, p, i) != "", F.regexp_extract(text, p, i))
    direction = F.when(text.rlike(_DIRECTION), F.when(F.regexp_extract(text, _DIRECTION, 1) != "", "debit").otherwise("credit"))
    account, date = group(_ACCOUNT, 1), group(TEXT_DATE, 1)
    credit = F.coalesce(direction == "credit", F.lit(False))
    return F.struct(
        ref.alias("transaction_id"), F.coalesce(parse_timestamp(F.replace(date, F.lit(" "), F.lit("-"))), date).alias("timestamp"),
        money["value"].alias("amount"), F.lit(None).cast("string").alias("amount_raw"), money["currency"].alias("currency"), direction.alias("direction"),
        F.when(credit, upi).otherwise(account).alias("sender"), F.when(credit, account).otherwise(upi).alias("receiver"),
        F.replace(F.upper(group(_METHOD, 1)), F.lit(" "), F.lit("")).alias("payment_method"), F.lit(None).cast("string").alias("status"),
        text.alias("description"), F.lit(None).cast("map<string,string>").alias("extra"), F.lit(None).cast("boolean").alias("has_time"),
    ).cast(TXN)


__all__ = ["ALIASES", "CURRENCIES", "FIELDS", "KEYWORDS", "TXN", "looks_like_alert", "normal_direction", "normal_key", "normalize_records", "parse_alert"]
