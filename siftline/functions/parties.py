"""Senders, receivers and money in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import once

PARTY = "struct<name:string,identifier:string,identifier_type:string,raw:string>"
NAME_ADDRESS = r"^\s*\"?([^\"<]*?)\"?\s*<([^>]+)>\s*$"
SMS_HEADER = r"(?m)^(?:from\s*:\s*)?([A-Z]{2}-[A-Z0-9]{5,8})(?:-[A-Z])?\b[:\s]*"
_SMS_WHOLE = r"^(?:from\s*:\s*)?[A-Z]{2}-[A-Z0-9]{5,8}(?:-[A-Z])?[:\s]*$"
_ACCOUNT = r"^[xX*]*\d{3,18}$"
_PHONE = r"^\+?\d[\d\s-]{8,14}\d$"


def _digits(col: Column) -> Column:
    return F.regexp_replace(col, r"[^0-9]", "")


def make_party(raw: Column, name: Column | None = None) -> Column:
    """Name, identifier and kind of identifier of a sender or receiver; null without either."""
    both = F.struct(raw.alias("raw"), (name if name is not None else F.lit(None).cast("string")).alias("name"))
    return once(both, lambda x: _party(x["raw"], x["name"]))


def _party(raw: Column, given: Column) -> Column:
    given = F.when(given != "", given)
    text = F.trim(F.coalesce(raw, F.lit("")))
    named = text.rlike(NAME_ADDRESS)
    in_address = F.trim(F.regexp_extract(text, NAME_ADDRESS, 1))
    ident = F.when(named, F.trim(F.regexp_extract(text, NAME_ADDRESS, 2))).otherwise(text)
    digits = _digits(ident)
    after_at = F.regexp_extract(ident, r"^[^@]*@(.*)$", 1)
    kind = (
        F.when(text == "", None)
        .when(ident.contains("@"), F.when(after_at.contains("."), "email").otherwise("upi_id"))
        .when(ident.rlike(_SMS_WHOLE), "sms_sender_id")
        .when(ident.rlike(_PHONE) & (F.length(digits) >= 10), "phone")
        .when(ident.rlike(_ACCOUNT), "account")
    )
    ten = F.right(digits, F.lit(10))
    phone = F.when(F.length(digits).isin(10, 12) & ten.rlike("^[6-9]"), F.concat(F.lit("+91"), ten)).otherwise(F.concat(F.lit("+"), digits))
    # an address' own name only counts if none is given
    name_then = F.coalesce(given, F.when(named & (in_address != ""), in_address))
    name_then = F.when((text != "") & kind.isNull(), F.coalesce(name_then, ident)).otherwise(name_then)
    value = F.when(kind.isin("email", "upi_id"), F.lower(ident)).when(kind == "phone", phone).when(kind.isNotNull(), ident)
    party = F.struct(name_then.alias("name"), value.alias("identifier"), kind.cast("string").alias("identifier_type"), F.coalesce(F.when(text != "", text), name_then).alias("raw"))
    return F.when((F.coalesce(raw, F.lit("")) == "") & given.isNull(), None).otherwise(party).cast(PARTY)


def party_label(party: Column) -> Column:
    name, ident = F.when(party["name"] != "", party["name"]), F.when(party["identifier"] != "", party["identifier"])
    both = F.concat(name, F.lit(" <"), ident, F.lit(">"))
    return F.coalesce(both, name, ident, party["raw"])


def identifier_key(party: Column) -> Column:
    """A form in which identifiers compare: accounts by the last four digits, phones by the last ten."""
    ident = F.lower(F.regexp_replace(party["identifier"], r"(?U)\s+", ""))
    digits = _digits(ident)
    key = F.when((party["identifier_type"] == "account") & (F.length(digits) >= 4), F.concat(F.lit("acct:"), F.right(digits, F.lit(4)))).when((party["identifier_type"] == "phone") & (F.length(digits) >= 10), F.concat(F.lit("phone:"), F.right(digits, F.lit(10)))).otherwise(ident)
    return F.when(party["identifier"] != "", key)


def name_key(party: Column) -> Column:
    return F.when(party["name"] != "", F.trim(F.regexp_replace(F.lower(party["name"]), r"(?U)\s+", " ")))


def reference_key(ref: Column) -> Column:
    key = F.upper(F.regexp_replace(ref, r"(?U)\s+", ""))
    return F.when(key != "", key)


def format_money(value: Column, currency: Column) -> Column:
    amount = F.format_number(value, 2)
    code = F.when(currency != "", currency)
    return F.when(value.isNull(), "an unknown amount").when(F.coalesce(code, F.lit("INR")) == "INR", F.concat(F.lit("₹"), amount)).otherwise(F.concat(code, F.lit(" "), amount))
