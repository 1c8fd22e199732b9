"""Raw items to normalised, tagged evidence (M1).

Every row becomes one evidence row: what can't be read becomes a message with a warning. All types are
found and built in one pass of expressions; only NFKC, delimited text, punycode and OCR use Python, each on
the rows that need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import once
from siftline.functions.text import ENTITIES, clean_text, content_hash, entities, nfkc, refang
from siftline.functions.transactions import looks_like_alert, normalize_records, parse_alert
from siftline.functions.urls import normalize_urls, with_display_hosts
from siftline.sources.raw import OcrEngine, image_type, json_records, tesseract, with_ocr, with_structured

LONE_URL = r"(?i)\A(?:(?:(?:https?|hxxps?)(?:://|\[://\])|www\.)\S+|(?:[a-z0-9-]+(?:\.|\[\.\])){1,127}[a-z]{2,}(?:/\S*)?)\z"
TYPES = ["message", "url", "transaction", "screenshot"]
LOW_CONFIDENCE = 0.6
FAILED_TEXT = 500
_SUMMARY = ["transaction_id", "timestamp", "direction", "amount", "currency", "payment_method", "sender", "receiver", "status"]
_FLAT = ["transaction_id", "timestamp", "amount", "amount_raw", "currency", "direction", "sender", "receiver", "payment_method", "status", "description"]


def number_text(value: Column) -> Column:
    """A number with at least one decimal and no exponent."""
    plain = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(value) < 1e7, value.cast("string")).otherwise(plain)


def _value(txn: Column, name: str) -> Column:
    return F.coalesce(number_text(txn["amount"]), txn["amount_raw"]) if name == "amount" else txn[name]


def _summary(txn: Column) -> Column:
    parts = [F.concat(F.lit(f"{n}="), _value(txn, n)) for n in _SUMMARY]
    text = F.concat_ws("; ", *parts)
    return F.when(text == "", refang(F.coalesce(txn["description"], F.lit("")))).otherwise(text)


def _flat(txn: Column) -> Column:
    values = F.array(*[F.when(v != "", v) for v in (_value(txn, n) if n == "amount" else txn[n] for n in _FLAT if n != "amount_raw")])
    extra = F.coalesce(F.map_values(txn["extra"]), F.array().cast("array<string>"))
    return F.array_join(F.filter(F.concat(values, extra), lambda v: v.isNotNull() & (v != "") & (v != "None")), " ")


def detect(text: Column, structured: Column) -> Column:
    """message, url or transaction, of a normalised text and the records found in it."""
    return F.when(text.rlike(LONE_URL), "url").when(structured.isNotNull() | once(text, looks_like_alert), "transaction").otherwise("message")


def ingest(raw: DataFrame, ocr: OcrEngine = tesseract) -> DataFrame:
    """Evidence rows of raw rows (see sources.raw.RAW)."""
    forced, data = F.col("forced_type"), F.col("bytes")
    df = raw.withColumn("mime", image_type(data))
    image = data.isNotNull() & (F.col("mime").isNotNull() | F.coalesce(forced == "screenshot", F.lit(False)))
    utf8 = F.is_valid_utf8(data)
    decoded = F.when(data.isNotNull(), F.when(utf8, F.decode(data, "UTF-8")).otherwise(F.decode(data, "ISO-8859-1")))
    as_records = F.col("json").isNotNull() & F.coalesce(forced.isNull() | (forced == "transaction"), F.lit(True))
    df = df.withColumns({"is_image": image, "as_records": as_records})
    df = df.withColumn("given", F.when(~F.col("is_image"), F.coalesce("text", "json", decoded)))
    fault = (
        F.when(forced.isNotNull() & ~forced.isin(TYPES), F.concat(F.lit("ingestion failed: '"), forced, F.lit("' is not a valid EvidenceType")))
        .when(~F.col("is_image") & F.coalesce(forced == "screenshot", F.lit(False)), "ingestion failed: screenshot evidence must be supplied as image bytes or a file path")
        .when(~F.col("is_image") & F.col("given").isNull(), "ingestion failed: unsupported evidence input")
    )
    latin = ~F.col("is_image") & data.isNotNull() & ~utf8 & F.col("text").isNull()
    df = df.withColumn("fault", fault).withColumn("latin", latin)
    df = df.withColumn("given", F.when(F.col("fault").isNotNull(), F.substring(F.coalesce("given", F.lit("")), 1, FAILED_TEXT)).otherwise(F.col("given")))

    df = with_ocr(df, F.when(F.col("is_image"), data), "ocr", ocr)
    df = df.withColumn("norm_source", nfkc(F.when(F.col("is_image"), F.coalesce("ocr.text", F.lit(""))).otherwise(F.coalesce("given", F.lit("")))))
    df = df.withColumn("norm", clean_text(F.col("norm_source")))
    df = with_structured(df, "norm", "found_records")
    # forced types and structured items don't need detection; images only use it for their text
    df = df.withColumn("looks", detect(F.col("norm"), F.col("found_records")))
    kind = F.when(F.col("fault").isNotNull(), "message").when(F.col("is_image"), "screenshot").when(F.col("as_records"), "transaction").otherwise(F.coalesce(forced, F.col("looks")))
    df = df.withColumn("evidence_type", kind)
    is_txn = F.col("evidence_type") == "transaction"
    records = F.when(is_txn, F.when(F.col("as_records"), json_records(F.col("json"))).otherwise(F.col("found_records")))
    df = df.withColumn("parsed", normalize_records(records))
    alert = (is_txn & F.col("parsed").isNull()) | ((F.col("evidence_type") == "screenshot") & (F.col("norm") != "") & (F.col("looks") == "transaction"))
    df = df.withColumn("alert", F.when(alert, parse_alert(F.col("norm"))))
    df = df.withColumn("transactions", F.when(is_txn, F.coalesce(F.transform("parsed", lambda p: p["txn"]), F.array("alert"))))

    summary = F.array_join(F.transform("transactions", _summary), "\n")
    flat = F.array_join(F.transform("transactions", _flat), "\n")
    df = df.withColumn("url_infos", F.when(F.col("evidence_type") == "url", normalize_urls(F.array("norm_source"))))
    df = df.withColumn("normalized_text", F.when(is_txn, summary).when(F.col("evidence_type") == "url", F.get("url_infos", F.lit(0))["canonical"]).otherwise(F.col("norm")))
    entity_text = F.when(is_txn & F.col("parsed").isNotNull(), flat).when(is_txn, F.col("norm")).otherwise(F.col("normalized_text"))
    df = df.withColumn("entities", entities(entity_text).cast(ENTITIES))
    df = df.withColumn("url_infos", F.coalesce("url_infos", normalize_urls(F.col("entities.urls"))))
    df = with_display_hosts(df, "url_infos")

    none = F.array().cast("array<string>")
    warnings = F.concat(
        F.coalesce(F.flatten(F.transform("parsed", lambda p: p["warnings"])), none),
        F.filter(F.array(
            F.col("fault"),
            F.when(is_txn & F.col("parsed").isNull() & F.col("alert.amount").isNull(), "no amount found in transaction text"),
            F.when((F.col("evidence_type") == "url") & (F.get("url_infos", F.lit(0))["host"] == ""), "could not determine host"),
            F.when(F.col("ocr.error").isNotNull(), F.concat(F.lit("OCR unavailable: "), F.col("ocr.error")))
            .when(F.col("is_image") & (F.col("norm") == ""), "OCR produced no text")
            .when(F.col("ocr.confidence") < LOW_CONFIDENCE, F.concat(F.lit("low OCR confidence ("), F.format_number(F.col("ocr.confidence"), 2), F.lit(")"))),
        ), lambda w: w.isNotNull()),
    )
    extra = F.filter(F.array(
        F.when(F.col("latin"), F.struct(F.lit("decoding").alias("key"), F.lit("latin-1").alias("value"))),
        F.when(F.col("is_image"), F.struct(F.lit("mime_type").alias("key"), F.col("mime").alias("value"))),
        F.when(is_txn, F.struct(F.lit("format").alias("key"), F.when(F.col("parsed").isNotNull(), "structured").otherwise("text").alias("value"))),
    ), lambda e: e.isNotNull())
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.exists(extra, lambda e: e["key"] == k))
    digest = F.when(F.col("is_image"), content_hash(data)).otherwise(content_hash(F.encode(F.coalesce("given", F.lit("")), "UTF-8")))
    df = df.withColumns({"warnings": warnings, "metadata": F.map_concat(kept, F.map_from_entries(extra)), "content_hash": digest})
    message = F.when(F.col("evidence_type") == "message", F.struct(F.length("norm").alias("char_count"), F.when(F.col("norm") == "", 0).otherwise(F.size(F.split("norm", "\n"))).alias("line_count")))
    shot = F.when(F.col("evidence_type") == "screenshot", F.struct(F.col("ocr.engine").alias("engine"), F.col("ocr.confidence").alias("confidence"), F.array("ocr.width", "ocr.height").alias("image_size"), F.col("ocr.lang").alias("lang"), F.when(F.col("norm") != "", F.col("looks")).alias("content_type"), F.col("alert").alias("transaction")))
    return df.select(
        "case_id", "rec_ord", F.substring(F.sha2(F.concat_ws("|", "case_id", "source", "rec_ord", "content_hash"), 256), 1, 32).alias("evidence_id"),
        "evidence_type", "normalized_text", "source", "content_hash", "metadata", "warnings", "entities", message.alias("message"), "url_infos", "transactions", shot.alias("ocr"),
    )
