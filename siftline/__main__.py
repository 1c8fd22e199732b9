"""spark-submit jobs: python -m siftline ingest|extract|timeline|check|redact|report ... (see --help of each).

Inputs and outputs of the steps are Parquet tables, so that each can be run on its own; `report` and the
text formats write files of the cases asked for.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.dates import DEFAULT_ZONE
from siftline.operators.checks import check
from siftline.operators.extract import extract
from siftline.operators.ingest import ingest
from siftline.operators.redact import SENSITIVE_TYPES, PLACEHOLDER, redact, redaction_counts
from siftline.operators.report import build_report
from siftline.operators.timeline import build_timeline
from siftline.plans import render
from siftline.sources.raw import RAW, raw_rows, read_domains, read_files, read_json_lines
from siftline.storage import settle


def _arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="siftline")
    steps = top.add_subparsers(dest="step", required=True)

    def step(name: str, about: str) -> argparse.ArgumentParser:
        p = steps.add_parser(name, help=about)
        p.add_argument("input", nargs="*", help="a table of the step before" if name != "ingest" else "files, or JSON Lines of raw rows (.jsonl)")
        p.add_argument("--out", required=True, help="where the result goes")
        return p

    p = step("ingest", "raw items to evidence")
    p.add_argument("--text", action="append", default=[], help="an item given as text; - is standard input")
    p.add_argument("--type", choices=["message", "url", "transaction", "screenshot"])
    p.add_argument("--case-id", default="case")
    p = step("extract", "evidence to records")
    p.add_argument("--blocklist")
    p.add_argument("--allowlist")
    for name in ("timeline", "check", "report"):
        p = step(name, f"records to {name}")
        p.add_argument("--tz", default=DEFAULT_ZONE)
        p.add_argument("--case-id", help="only this case; needed for formats other than parquet")
        p.add_argument("--format", action="append", choices=["parquet", "json", "text", "markdown"], default=None)
        if name == "report":
            p.add_argument("--no-redact", action="store_true")
    p = step("redact", "records to redacted records; counts go to standard error")
    p.add_argument("--types", default=",".join(SENSITIVE_TYPES))
    p.add_argument("--placeholder", default=PLACEHOLDER)
    return top.parse_args(argv)


def _raw(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    texts = [sys.stdin.read() if t == "-" else t for t in a.text]
    rows = raw_rows(spark, [{"case_id": a.case_id, "text": t, "forced_type": a.type} for t in texts])
    for path in a.input:
        more = read_json_lines(spark, path, RAW) if path.endswith(".jsonl") else read_files(spark, path, a.case_id, a.type)
        rows = rows.unionByName(more)
    return rows


def _write(a: argparse.Namespace, table: DataFrame, as_text=None, as_markdown=None, as_json=None) -> None:
    formats = a.format or ["parquet"]
    if "parquet" in formats:
        table.write.mode("overwrite").parquet(a.out)
    makers = {"text": ("txt", as_text), "markdown": ("md", as_markdown), "json": ("json", as_json)}
    for name in formats:
        if name != "parquet":
            ending, make = makers[name]
            with open(f"{a.out}.{ending}", "w", encoding="utf-8") as f:
                f.write(make() + "\n")


def main(argv: list[str]) -> int:
    a = _arguments(argv)
    if getattr(a, "format", None) and set(a.format) != {"parquet"} and not a.case_id:
        sys.exit("formats other than parquet need --case-id: they are of one case")
    spark = SparkSession.builder.appName(f"siftline {a.step}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.step == "ingest":
        ingest(_raw(spark, a)).write.mode("overwrite").parquet(a.out)
        return 0
    table = spark.read.parquet(*a.input)
    if getattr(a, "case_id", None):
        table = table.filter(F.col("case_id") == a.case_id)
    if a.step == "extract":
        lists = [[r["domain"] for r in read_domains(spark, p, "").collect()] if p else [] for p in (a.blocklist, a.allowlist)]
        extract(table, *lists).write.mode("overwrite").parquet(a.out)
    elif a.step == "redact":
        out = settle(redact(table, types=a.types.split(","), placeholder=a.placeholder))
        out.drop("redactions").write.mode("overwrite").parquet(a.out)
        for r in redaction_counts(out).orderBy("case_id", "kind").collect():
            print(r["case_id"], r["kind"], r["n"], file=sys.stderr)
    elif a.step == "report":
        reports = settle(build_report(table, datetime.now(timezone.utc).isoformat(), a.tz, not a.no_redact))
        if "parquet" in (a.format or ["parquet"]):
            reports.write.mode("overwrite").parquet(a.out)
        kinds = tuple(f for f in a.format or [] if f != "parquet")
        if kinds:
            render.save_report(reports.first().asDict(True), a.out, kinds)
    else:
        events, summary = (settle(df) for df in build_timeline(table, a.tz))
        rows = lambda df, order: [r.asDict(True) for r in df.orderBy(order).collect()]
        dump = lambda x: json.dumps(x, ensure_ascii=False, indent=2, default=str)
        if a.step == "timeline":
            args = lambda: (a.case_id, a.tz, rows(summary, "case_id")[0], rows(events, "sequence"))
            _write(a, events, lambda: render.timeline_text(*args()), lambda: render.timeline_markdown(*args()), lambda: dump({"summary": args()[2], "events": args()[3]}))
        else:
            issues, counts = check(events)
            args = lambda: (a.case_id, rows(counts, "case_id")[0], rows(issues, "n"))
            _write(a, issues, lambda: render.issues_text(*args()), lambda: render.issues_markdown(*args()), lambda: dump({"summary": args()[1], "issues": args()[2]}))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
