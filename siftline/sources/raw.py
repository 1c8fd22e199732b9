"""Raw evidence as rows: files, JSON Lines, domain lists, case files; OCR engines; stores and report files."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.transactions import ALIASES

RAW = "case_id string, rec_ord int, source string, text string, bytes binary, json string, forced_type string, metadata map<string,string>"
TEXT_EXTENSIONS = ["txt", "json", "csv", "tsv", "eml", "log", "md", ""]

#: How image files begin.
IMAGE_SIGNATURES = [("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff")]


def image_type(data: Column) -> Column:
    """The MIME type of an image by its first bytes, else null."""
    out = F.when((F.hex(F.substring(data, 1, 4)) == "52494646") & (F.hex(F.substring(data, 9, 4)) == "57454250"), "image/webp")
    for sign, mime in IMAGE_SIGNATURES:
        out = out.when(F.hex(F.substring(data, 1, len(sign) // 2)) == sign, mime)
    return out


def raw_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows given as dicts with any of the raw columns; rec_ord defaults to the order within a case."""
    schema = T._parse_datatype_string(RAW)
    seen: dict = {}
    full = []
    for r in rows:
        case = r.get("case_id", "case")
        n = seen[case] = seen.get(case, -1) + 1
        base = {"case_id": case, "rec_ord": n, "source": "direct", "metadata": {}} | r
        full.append(tuple(base.get(f.name) for f in schema.fields))
    return spark.createDataFrame(full, schema)


def read_files(spark: SparkSession, path: str, case_id: str = "case", forced_type: str | None = None) -> DataFrame:
    """Files as raw rows: their bytes, name and size, and a note if the extension isn't one of text or image."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    odd = ~extension.isin(TEXT_EXTENSIONS) & image_type(F.col("content")).isNull()
    meta = F.map_concat(F.create_map(F.lit("filename"), name, F.lit("size_bytes"), F.col("length").cast("string")), F.when(odd, F.create_map(F.lit("unrecognized_extension"), F.concat(F.lit("."), extension))).otherwise(F.create_map().cast("map<string,string>")))
    # numbered in the order of their paths: only paths are sorted, contents aren't read for it
    numbers = files.select(F.col("path").alias("of_path")).select("of_path", (F.row_number().over(W.orderBy("of_path")) - 1).alias("file_ord"))
    files = files.join(numbers, F.col("path") == F.col("of_path"))
    order = F.col("file_ord").cast("int")
    null = F.lit(None).cast("string")
    return files.select(F.lit(case_id).alias("case_id"), order.alias("rec_ord"), F.concat(F.lit("file:"), F.regexp_replace("path", "^file:/*", "/")).alias("source"), null.alias("text"), F.col("content").alias("bytes"), null.alias("json"), F.lit(forced_type).cast("string").alias("forced_type"), meta.alias("metadata"))


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """One object a line, with an explicit schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_domains(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A list of domains, a line each; blank lines and lines that begin with # are skipped."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("domain")).filter((F.col("domain") != "") & ~F.col("domain").startswith("#")).select(F.lower("domain").alias("domain"), F.lit(kind).alias("kind"))


def read_documents(spark: SparkSession, path: str, item_schema: str, list_field: str) -> DataFrame:
    """Items of JSON files that are a list, an object with a list in `list_field`, one item, or JSON Lines; with case_id."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    listed = F.from_json("t", f"array<{item_schema}>")
    nested = F.from_json("t", f"struct<case_id:string,{list_field}:array<{item_schema}>>")
    single = F.from_json("t", item_schema)
    lines = F.transform(F.filter(F.split("t", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, item_schema))
    many = F.size(F.filter(F.split("t", "\n"), lambda x: F.trim(x).startswith("{"))) > 1
    is_lines = F.col("t").startswith("{") & many & ~F.coalesce(F.get_json_object("t", f"$.{list_field}").isNotNull(), F.lit(False)) & F.col("t").rlike(r"\}\s*\n\s*\{")
    items = F.when(F.col("t").startswith("["), listed).when(is_lines, lines).when(nested[list_field].isNotNull(), nested[list_field]).otherwise(F.array(single))
    return text.select(nested["case_id"].alias("case_id"), F.posexplode(items).alias("item_ord", "item"))


# ------------------------------------------------------------- structured text


@F.pandas_udf(T.StringType())
def _csv_rows(texts: pd.Series) -> pd.Series:
    amount_names = set(ALIASES["amount"])

    def rows(text):
        if text is None:
            return None
        try:
            dialect = csv.Sniffer().sniff(text.split("\n", 1)[0], delimiters=",;\t")
            got = list(csv.DictReader(io.StringIO(text), dialect=dialect))
        except csv.Error:
            return None
        if not got:
            return None
        names = {"_".join(filter(None, "".join(c if c.isascii() and c.isalnum() else " " for c in str(h).lower()).split())) for h in got[0]}
        if not names & amount_names:
            return None
        return json.dumps([{k: v for k, v in r.items() if k is not None and (v is None or isinstance(v, str))} for r in got], ensure_ascii=False)

    return texts.map(rows)


_csv_rows = _csv_rows.asNondeterministic()


def with_structured(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the records (array<map<string,string>>) that a text holds as JSON or delimited rows; null if it holds none.

    Only texts whose first of several lines has a delimiter are sent to Python.
    """
    maybe = F.col(text).rlike(r"\A[^\n]*[,;\t][^\n]*\n") & ~F.col(text).rlike(r"\A\s*[\[{]")
    df = df.withColumn("csv_json", _csv_rows(F.when(maybe, F.col(text))))
    return df.withColumn(out, F.coalesce(json_records(F.col(text)), F.from_json("csv_json", "array<map<string,string>>"))).drop("csv_json")


def json_records(text: Column) -> Column:
    head = F.substring(F.ltrim(text), 1, 1)
    many = F.from_json(F.when(head == "[", text), "array<map<string,string>>")
    one = F.from_json(F.when(head == "{", text), "map<string,string>")
    good = F.when((F.size(many) > 0) & F.forall(many, lambda m: m.isNotNull()), many)
    return F.coalesce(good, F.when(one.isNotNull(), F.array(one)))


# ------------------------------------------------------------------------ OCR

OCR = "struct<text:string,engine:string,confidence:double,width:int,height:int,lang:string,error:string>"
OcrEngine = Callable[[bytes], dict]


def tesseract(data: bytes, lang: str = "eng", upscale_below: int = 1000) -> dict:
    """Text of an image by Tesseract, if pillow, pytesseract and the program are there; else an error."""
    try:
        import pytesseract
        from PIL import Image, ImageOps
    except ImportError:
        return {"error": "Tesseract OCR requires 'pillow' and 'pytesseract'"}
    try:
        image = Image.open(io.BytesIO(data))
        width, height = image.size
        grey = ImageOps.autocontrast(ImageOps.grayscale(image))
        if width < upscale_below:
            grey = grey.resize((upscale_below, int(height * upscale_below / width)))
        words = pd.DataFrame(pytesseract.image_to_data(grey, lang=lang, output_type=pytesseract.Output.DICT))
    except pytesseract.TesseractNotFoundError:
        return {"error": "tesseract binary not found on PATH"}
    words = words[words["text"].str.strip() != ""]
    lines = words.groupby(["block_num", "par_num", "line_num"], sort=True)["text"].agg(" ".join)
    sure = pd.to_numeric(words["conf"])
    sure = sure[sure >= 0]
    return {"text": "\n".join(lines), "engine": "tesseract", "confidence": round(float(sure.mean()) / 100, 3) if len(sure) else None, "width": width, "height": height, "lang": lang}


def with_ocr(df: DataFrame, data: Column, out: str, engine: OcrEngine = tesseract) -> DataFrame:
    """df with what an OCR engine (bytes to a dict of the OCR fields) reads; rows where `data` is null aren't sent to it."""
    names = T._parse_datatype_string(f"x {OCR}").fields[0].dataType.names

    @F.pandas_udf(OCR)
    def read(images: pd.Series) -> pd.DataFrame:
        got = [engine(bytes(b)) if b is not None else {} for b in images]
        return pd.DataFrame({n: pd.array([g.get(n) for g in got], dtype={"confidence": "Float64", "width": "Int32", "height": "Int32"}.get(n, "object")) for n in names})

    return df.withColumn(out, F.when(data.isNotNull(), read.asNondeterministic()(data)))


# ---------------------------------------------------------------------- stores


def upsert(existing: DataFrame, new: DataFrame, key: str = "evidence_id") -> DataFrame:
    """Records of both by case and key: the newest of each, at the place of the first; a null key is never replaced."""
    both = existing.withColumn("store_gen", F.lit(0)).unionByName(new.withColumn("store_gen", F.lit(1)), allowMissingColumns=True)
    same = W.partitionBy("case_id", F.coalesce(F.col(key), F.concat(F.lit("\x00"), F.col("store_gen"), F.lit(":"), F.col("rec_ord"))))
    last = same.orderBy(F.desc("store_gen"), F.desc("rec_ord"))
    # new records follow the existing ones of their case
    offset = F.max(F.when(F.col("store_gen") == 0, F.col("rec_ord"))).over(W.partitionBy("case_id"))
    place = F.when(F.col("store_gen") == 0, F.col("rec_ord")).otherwise(F.coalesce(offset, F.lit(-1)) + 1 + F.col("rec_ord")).cast("int")
    both = both.withColumn("place", place).withColumn("first_place", F.min("place").over(same)).withColumn("rank", F.row_number().over(last))
    return both.filter("rank = 1").withColumn("rec_ord", F.col("first_place")).drop("store_gen", "place", "first_place", "rank")


def save_cases(records: DataFrame, path: str) -> None:
    """Records partitioned by case; only the partitions of cases that are there are replaced."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(path)


def case_json(records: DataFrame, generated_at: str) -> DataFrame:
    """One JSON document a case: schema_version, case_id, generated_at, record_count, records in order."""
    fields = [c for c in records.columns if c not in ("case_id", "rec_ord")]
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rec_ord", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("j")))), lambda r: r["j"])
    cases = records.groupBy("case_id").agg(rows.alias("rows"))
    head = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.col("case_id"), F.lit(generated_at).alias("generated_at"), F.size("rows").alias("record_count")))
    return cases.select("case_id", F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"records":['), F.array_join("rows", ","), F.lit("]}")).alias("document"))
