"""Text normalisation and entity extraction as Column expressions.

Patterns use (?U), so that \\w, \\d and \\b are Unicode. Repetitions are possessive, and a match begins where its run
begins (or the last match ended): a long run neither exhausts the regular expression engine's stack nor is it
rescanned from each place. A host name has at most 127 labels.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import once

# Characters that are removed, currency names, top-level domains of bare addresses, and the patterns below.
INVISIBLE = "​‌‍‎‏‪‫‬‭‮⁠﻿­"
CURRENCIES = {"₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupees": "INR", "$": "USD", "usd": "USD", "dollars": "USD", "€": "EUR", "eur": "EUR"}
BARE_TLDS = ["com", "in", "net", "org", "info", "xyz", "top", "online", "site", "club", "co", "io", "ly", "me", "app", "link", "live", "shop", "biz"]

_NUMBER = r"\d{1,3}(?:,\d{2,3})++(?:\.\d{1,2})?|(?:\G|(?<!\d))\d++(?:\.\d{1,2})?"
URL = rf"(?iU)(?<![@\w.-])((?:https?://|www\.)[^\s<>\"'()]+|(?:[a-z0-9-]+\.){{1,127}}(?:{'|'.join(BARE_TLDS)})(?:/[^\s<>\"'()]*)?)"
EMAIL = r"(?iU)(?:\G|(?<![\w.+-]))[\w.+-]++@[a-z0-9-]+(?:\.[a-z0-9-]+){0,126}\.[a-z]{2,}\b"
UPI = r"(?iU)\b[\w.-]{1,256}@[a-z]{2,64}(?![\w.-])"
PHONE = r"(?U)(?<![\d\w])(?:\+?91[\s-]?|0)?[6-9]\d{4}[\s-]?\d{5}(?!\d)"
AMOUNT = rf"(?iU)(₹|rs\.?|inr|\$|usd|€|eur)\s*({_NUMBER})|({_NUMBER})\s*(rs\.?|inr|rupees|usd|dollars)\b"
REFERENCE = r"(?iU)\b(?:utr|rrn|ref(?:erence)?|txn|transaction)\s*(?:no\.?|id|number|#)?\s*[:\-]?\s*([A-Z0-9]{8,22})\b"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Not collapsed into later expressions: a Python function can't be inside a lambda.
_nfkc = _nfkc.asNondeterministic()


def nfkc(col: Column) -> Column:
    """NFKC form. Only texts beyond ASCII are sent to Python; the others are passed as nulls."""
    return F.coalesce(_nfkc(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\A\s+|\s+\z", "")


def clean_text(col: Column) -> Column:
    """Normalisation without NFKC: invisible characters out, \\n as the only line end, blanks collapsed, lines stripped."""
    col = F.translate(col, INVISIBLE, "")
    col = F.regexp_replace(col, r"\r\n?", "\n")
    col = F.regexp_replace(col, r"[ \t\f\x0B]+", " ")
    col = F.regexp_replace(col, r"(?mdU)^[^\S\n]+|[^\S\n]+$", "")
    return strip(F.regexp_replace(col, r"\n{3,}", "\n\n"))


def normalize_text(col: Column) -> Column:
    return clean_text(nfkc(col))


def refang(col: Column) -> Column:
    """Undoes the defanging of links: hxxp, [.], (dot), [:]."""
    col = F.regexp_replace(col, r"(?iU)\bhxxp(s?)", "http$1")
    col = F.regexp_replace(col, r"(?i)\[(?:\.|dot)\]|\((?:\.|dot)\)|\{\.\}", ".")
    return F.regexp_replace(col, r"\[(:|://)\]", "$1")


def parse_amount(col: Column) -> Column:
    return F.replace(col, F.lit(","), F.lit("")).try_cast("double")


def lookup(col: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    """The value of a small fixed table."""
    out = otherwise if otherwise is not None else F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)).otherwise(out)
    return out


def _all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def urls(col: Column) -> Column:
    """Links of a refanged text, without trailing punctuation, each once, in order."""
    return F.array_distinct(F.transform(_all(col, URL, 1), lambda u: F.regexp_replace(u, r"[.,;:!?]+\z", "")))


def emails(col: Column) -> Column:
    """Addresses in lower case, each once, in order; marks before the first letter or digit don't belong to one."""
    found = F.transform(_all(col, EMAIL), lambda e: F.regexp_replace(F.lower(e), r"\A[.+-]+", ""))
    return F.array_distinct(F.filter(found, lambda e: ~e.startswith("@")))


def upi_ids(col: Column) -> Column:
    return F.array_except(F.transform(_all(col, UPI), F.lower), emails(col))


def phone_numbers(col: Column) -> Column:
    return F.array_distinct(F.transform(_all(col, PHONE), lambda p: F.concat(F.lit("+91"), F.right(F.regexp_replace(p, r"(?U)\D", ""), F.lit(10)))))


def amounts(col: Column) -> Column:
    """Sums of money: value, currency code, and how they are written."""

    def parts(m):
        currency = F.lower(F.concat(F.regexp_extract(m, AMOUNT, 1), F.regexp_extract(m, AMOUNT, 4)))
        number = F.concat(F.regexp_extract(m, AMOUNT, 2), F.regexp_extract(m, AMOUNT, 3))
        return F.struct(parse_amount(number).alias("value"), lookup(currency, CURRENCIES, F.upper(currency)).alias("currency"), F.trim(m).alias("raw"))

    return F.filter(F.transform(_all(col, AMOUNT), parts), lambda a: a["value"].isNotNull())


def reference_numbers(col: Column) -> Column:
    return F.array_distinct(F.filter(_all(col, REFERENCE, 1), lambda r: r.rlike("[0-9]")))


def entities(col: Column) -> Column:
    """All entities of a text as one struct."""
    return once(refang(col), _entities)


def _entities(text: Column) -> Column:
    return F.struct(
        urls(text).alias("urls"),
        emails(text).alias("emails"),
        phone_numbers(text).alias("phone_numbers"),
        upi_ids(text).alias("upi_ids"),
        amounts(text).alias("amounts"),
        reference_numbers(text).alias("reference_numbers"),
    )


ENTITIES = "struct<urls:array<string>,emails:array<string>,phone_numbers:array<string>,upi_ids:array<string>,amounts:array<struct<value:double,currency:string,raw:string>>,reference_numbers:array<string>>"


def content_hash(col: Column) -> Column:
    """SHA-256 of text in UTF-8, or of bytes."""
    return F.sha2(col, 256)


def snippet(col: Column, limit: int) -> Column:
    """A text on one line, cut with an ellipsis."""
    flat = strip(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), r"(?U)\s+\z", ""), F.lit("…")))


def capitalize_first(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, 2, 1 << 30))


def nullif_blank(col: Column) -> Column:
    return F.when(col != "", col)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
