"""Dates: a chain of formats to ISO 8601 text, resolution in a time zone, and spans of time in words.

Times stay text in ISO form, with an offset only if one was given, until resolve() places them in a zone. All
timestamps are computed with spark.sql.session.timeZone=UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import once

# Date formats in the order in which they are tried; True: two-digit years up to 68 are 20xx.
FORMATS = [
    (r"\d{1,4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}", "yyyy-M-d'T'H:m:s"),
    (r"\d{1,4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}", "yyyy-M-d H:m:s"),
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}", "d-M-yyyy H:m:s"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}", "d/M/yyyy H:m:s"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{2}", "d-M-yy"),
    (r"\d{1,2}/\d{1,2}/\d{2}", "d/M/yy"),
    (r"\d{1,2}-[A-Za-z]{3}-\d{4}", "d-MMM-yyyy"),
    (r"\d{1,2}-[A-Za-z]{3}-\d{2}", "d-MMM-yy"),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"),
    (r"\d{1,2}[A-Za-z]{3}\d{2}", "dMMMyy"),
    (r"\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{1,2}", "d MMM yyyy H:m"),
]
CHAT_FORMATS = [
    (r"\d{1,2}/\d{1,2}/\d{2} \d{1,2}:\d{1,2}:\d{1,2} [AaPp][Mm]", "d/M/yy h:m:s a"),
    (r"\d{1,2}/\d{1,2}/\d{2} \d{1,2}:\d{1,2} [AaPp][Mm]", "d/M/yy h:m a"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2} [AaPp][Mm]", "d/M/yyyy h:m:s a"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2} [AaPp][Mm]", "d/M/yyyy h:m a"),
    (r"\d{1,2}/\d{1,2}/\d{2} \d{1,2}:\d{1,2}:\d{1,2}", "d/M/yy H:m:s"),
    (r"\d{1,2}/\d{1,2}/\d{2} \d{1,2}:\d{1,2}", "d/M/yy H:m"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}", "d/M/yyyy H:m"),
    (r"\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}", "d-M-yyyy H:m"),
    (r"\d{1,2}-\d{1,2}-\d{2} \d{1,2}:\d{1,2}", "d-M-yy H:m"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}", "yyyy-M-d H:m"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}", "yyyy-M-d'T'H:m"),
]
_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:[.,](\d{1,6})\d*)?)?(Z|[+-]\d{2}:?\d{2})?$"
_RFC = r"^\s*(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}:\d{2}(?::\d{2})?)(?:\s+([+-]\d{4}|GMT|UT|UTC|Z))?"
TEXT_DATE = r"(?U)\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}[- ]?[A-Za-z]{3}[- ]?\d{2,4})\b"
TEXT_DATETIME = r"(?U)\b(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}(?:,?\s+\d{1,2}:\d{2}(?::\d{2})?(?:\s?[AaPp][Mm])?)?|\d{1,2}[- ][A-Za-z]{3}[- ]\d{2,4})\b"

DEFAULT_ZONE = "Asia/Kolkata"
#: Times from these sources carry a time of day; elsewhere midnight means that only the date is known, unless it was given.
PRECISE_SOURCES = ["header", "chat_export", "metadata"]


def _iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def _by_formats(text: Column, formats: list[tuple[str, str]]) -> Column:
    found = []
    for shape, fmt in formats:
        ts = F.try_to_timestamp(F.when(text.rlike(f"^{shape}$"), text), F.lit(fmt))
        if "yyyy" not in fmt:
            ts = F.when(F.year(ts) >= 2069, F.add_months(ts.cast("date"), -1200).cast("timestamp") + (ts - F.date_trunc("day", ts))).otherwise(ts)
        found.append(_iso_text(ts))
    return F.coalesce(*found)


def _from_iso(text: Column) -> Column:
    date, hm, s, frac, zone = (F.regexp_extract(text, _ISO, i) for i in range(1, 6))
    base = F.concat(date, F.lit("T"), F.when(hm == "", "00:00").otherwise(hm), F.when(s == "", ":00").otherwise(s))
    valid = F.try_to_timestamp(F.when(text.rlike(_ISO) & ~((hm == "") & (zone != "")), base), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
    micro = F.when((frac == "") | F.rpad(frac, 6, "0").rlike("^0+$"), "").otherwise(F.concat(F.lit("."), F.rpad(frac, 6, "0")))
    offset = F.when(zone == "Z", "+00:00").when(F.length(zone) == 5, F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise(zone)
    return F.when(valid, F.concat(base, micro, offset))


def parse_timestamp(col: Column) -> Column:
    """ISO text of an ISO date or time, of one of FORMATS, or of 10 or 13 digits (Unix seconds or milliseconds, in UTC)."""
    return once(F.trim(col), _timestamp)


def _timestamp(text: Column) -> Column:
    compact = F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))
    seconds = F.when(text.rlike(r"^\d{10}$"), text.try_cast("long")).when(text.rlike(r"^\d{13}$"), F.floor(text.try_cast("long") / 1000))
    return F.coalesce(_from_iso(text), _from_iso(compact), _by_formats(text, FORMATS), _iso_text(F.timestamp_seconds(seconds)))


def parse_datetime(col: Column) -> Column:
    """parse_timestamp, then the forms of chat exports, then those of e-mail headers."""
    return once(col, lambda c: F.coalesce(_timestamp(F.trim(c)), _chat_or_mail(c)))


def _chat_or_mail(col: Column) -> Column:
    text = F.trim(F.regexp_replace(F.replace(col, F.lit(","), F.lit(" ")), r"\s+", " "))
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)a\.?m\.?$", "AM"), r"(?i)p\.?m\.?$", "PM")
    day, month, year, hm, zone = (F.regexp_extract(col, _RFC, i) for i in range(1, 6))
    mail = F.try_to_timestamp(F.when(col.rlike(_RFC), F.concat_ws(" ", day, month, year, F.when(F.length(hm) <= 5, F.concat(hm, F.lit(":00"))).otherwise(hm))), F.lit("d MMM yyyy H:m:s"))
    offset = F.when(zone == "", "").when(zone.rlike("^[+-]"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise("+00:00")
    return F.coalesce(once(text, lambda t: _by_formats(t, CHAT_FORMATS)), F.concat(_iso_text(mail), offset))


def resolve(iso: Column, source: Column, zone: str = DEFAULT_ZONE, has_time: Column | None = None) -> Column:
    """struct(utc: the instant, local: the wall clock in `zone`, both as timestamps, precision, text). has_time: whether a time of day was given."""
    given = F.coalesce(source.isin(PRECISE_SOURCES), F.lit(False)) | F.coalesce(F.lit(False) if has_time is None else has_time, F.lit(False))
    return once(F.struct(iso.alias("iso"), given.alias("given")), lambda x: once(_placed(x["iso"], x["given"], zone), lambda y: _shown(y, zone)))


def _placed(iso: Column, given: Column, zone: str) -> Column:
    offset = F.regexp_extract(iso, r"([+-]\d{2}:\d{2})$", 1)
    plain = F.try_to_timestamp(F.regexp_replace(iso, r"[+-]\d{2}:\d{2}$", ""))
    plain = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), plain)
    minutes = (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int")) * F.when(offset.startswith("-"), -1).otherwise(1)
    utc = F.when(offset == "", F.to_utc_timestamp(plain, zone)).otherwise(F.timestamp_micros(F.unix_micros(plain) - minutes.cast("long") * 60_000_000))
    midnight = (offset == "") & (plain == F.date_trunc("day", plain)) & ~given
    precision = F.when(utc.isNull(), "unknown").when(midnight, "date").otherwise("datetime")
    return F.struct(utc.alias("utc"), F.from_utc_timestamp(utc, zone).alias("local"), precision.alias("precision"))


def _shown(y: Column, zone: str) -> Column:
    utc, local, precision = y["utc"], y["local"], y["precision"]
    ahead = F.floor((F.unix_micros(local) - F.unix_micros(utc)) / 60_000_000).cast("int")
    sign = F.when(ahead < 0, "-").otherwise("+")
    shift = F.format_string("%s%02d:%02d", sign, F.floor(F.abs(ahead) / 60).cast("int"), F.abs(ahead) % 60)
    micro = F.unix_micros(local) % 1_000_000
    text = F.when(precision == "date", F.date_format(local, "yyyy-MM-dd")).otherwise(F.concat(_iso_text(local), F.when(micro == 0, "").otherwise(F.format_string(".%06d", micro)), shift))
    return F.struct(utc.alias("utc"), local.alias("local"), precision.alias("precision"), text.alias("text"))


def humanize(seconds: Column) -> Column:
    """A number of seconds as days, hours and minutes, or as seconds if under a minute."""
    return once(seconds, _in_words)


def _in_words(seconds: Column) -> Column:
    s = F.abs(seconds).cast("long")
    part = lambda v, u: F.when(v > 0, F.concat(v.cast("string"), F.lit(u)))
    words = F.concat_ws(" ", part(F.floor(s / 86400), "d"), part(F.floor(s % 86400 / 3600), "h"), part(F.floor(s % 3600 / 60), "m"))
    words = F.when(words == "", F.concat((s % 60).cast("string"), F.lit("s"))).otherwise(words)
    return F.when(seconds < 0, F.concat(F.lit("-"), words)).otherwise(words)


def minute_text(iso: Column) -> Column:
    """An ISO time to the minute; dates and other texts as they are."""
    return F.when(F.length(iso) == 10, iso).otherwise(F.coalesce(F.replace(F.get(F.regexp_extract_all(iso, F.lit(r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})"), F.lit(1)), F.lit(0)), F.lit("T"), F.lit(" ")), iso))
