"""The evidence engine: a scam case from raw items to the redacted report, tables of functions, and edge cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siftline.functions import dates, parties, text, transactions, urls
from siftline.operators.checks import check
from siftline.operators.extract import extract
from siftline.operators.ingest import ingest
from siftline.operators.redact import redact, redact_text
from siftline.operators.report import build_report
from siftline.operators.timeline import build_timeline
from siftline.plans import render
from siftline.sources.raw import case_json, raw_rows, read_domains, upsert
from siftline.storage import settle

PNG = b"\x89PNG\r\n\x1a\n" + bytes(32)
SMS = "VM-SBIINB: Your account will be blocked today. Update KYC at http://sbi-kyc.top/verify"
CHAT = "[12/03/24, 10:20:00 AM] Ravi Kumar: Pay Rs 5000 to scam.pay@ybl now\n[12/03/24, 10:21:00 AM] Me: ok"
ALERT = "Rs.5,000.00 debited from A/c XX1234 on 12-03-24 to VPA scam.pay@ybl UPI Ref 412345678901"
FAILED = json.dumps({"txn_id": "T900001", "amount": "700", "to": "scam.pay@ybl", "mode": "UPI", "status": "FAILED", "date": "2024-03-12T11:00:00"})
STATEMENT = "Date,Narration,Debit,Credit\n11/03/2024,UPI/scam.pay@ybl/x,,1.00\n13/03/2024,UPI/shop@okaxis/x,250,"
MAIL = "From: Bank <a@b.com>\nTo: me@x.com\nDate: Tue, 12 Mar 2024 10:15:00 +0530\nSubject: KYC\n\nShare your OTP"


def values(spark, rows, expr):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


@pytest.mark.parametrize("raw,iso", [
    ("2024-03-12T10:15:00Z", "2024-03-12T10:15:00+00:00"), ("12-03-24", "2024-03-12T00:00:00"), ("12/03/24, 10:15:02 AM", "2024-03-12T10:15:02"), ("12/03/2024 22:15", "2024-03-12T22:15:00"),
    ("Tue, 12 Mar 2024 10:15:00 +0530", "2024-03-12T10:15:00+05:30"), ("31/12/75", "1975-12-31T00:00:00"), ("5 Jan 1999", "1999-01-05T00:00:00"), ("12Mar24", "2024-03-12T00:00:00"), ("2024-02-31", None), ("soon", None), ("", None), (None, None),
])
def test_dates(spark, raw, iso):
    assert values(spark, [raw], dates.parse_datetime) == [iso]


def test_parties(spark):
    got = values(spark, ["scam@ybl", "A B <A.b@x.com>", "VM-SBIINB", "+91 98765 43210", "XX1234", "John", "", None], parties.make_party)
    assert [p and (p.name, p.identifier, p.identifier_type) for p in got] == [(None, "scam@ybl", "upi_id"), ("A B", "a.b@x.com", "email"), (None, "VM-SBIINB", "sms_sender_id"), (None, "+919876543210", "phone"), (None, "XX1234", "account"), ("John", None, None), None, None]


def test_entities(spark):
    e = values(spark, ["Pay ₹1,20,000 or 500 rupees to abc@ybl, mail A.b@x.co.in, call 98765 43210, see hxxp://bad[.]top/x. UTR 12345678AB"], text.entities)[0]
    assert [(a.value, a.currency) for a in e.amounts] == [(120000.0, "INR"), (500.0, "INR")]
    assert (e.upi_ids, e.emails, e.phone_numbers, e.reference_numbers) == (["abc@ybl"], ["a.b@x.co.in"], ["+919876543210"], ["12345678AB"])
    assert e.urls == ["http://bad.top/x"]


def test_long_texts_do_not_exhaust_the_stack(spark):
    e = values(spark, ["a." * 30000 + " 1" + ",11" * 20000, "x@" + "y." * 20000, " " * 50000, None], text.entities)
    assert len(e) == 4


def test_text(spark):
    assert values(spark, ["ａ​b \t c\r\n\r\n\r\n\r\nd  ", "", None], text.normalize_text) == ["ab c\n\nd", "", None]


@pytest.mark.parametrize("url,canonical,verdict", [
    ("HXXPS://SBI-kyc-update[.]xyz/Verify?utm_source=a&x=1&x=2#f", "https://sbi-kyc-update.xyz/Verify?x=1&x=2", "malicious"), ("http://192.168.0.1:8080/login", "http://192.168.0.1:8080/login", "malicious"),
    ("example.com:80", "http://example.com/", "benign"), ("https://user:p@Bank.co.in:443/a?q=%20*~", "https://bank.co.in/a?q=+%2A~", "suspicious"), ("bit.ly/abc", "http://bit.ly/abc", "suspicious"), ("", "http:///", "suspicious"),
])
def test_urls(spark, url, canonical, verdict):
    r = values(spark, [url], lambda c: F.get(urls.reputations(F.array(urls.normalize_url(c))), F.lit(0)))[0]
    assert (r.url, r.verdict) == (canonical, verdict)


def test_lists_win(spark):
    info = lambda c: F.array(urls.normalize_url(c))
    blocked, allowed = (values(spark, ["http://sub.evil.com/login"], lambda c, a=a: F.get(urls.reputations(info(c), **a), F.lit(0)))[0] for a in ({"block": ["evil.com"]}, {"allow": ["EVIL.com"]}))
    assert (blocked.score, blocked.verdict, allowed.score) == (100, "malicious", 0)


def test_records_of_any_columns(spark):
    rows = [{"Txn ID": "T1 ", "Amount": "Rs. 5,000", "to": "x@ybl", "mode": "upi", "device": "d"}, {"Credit": "1.00", "Debit": ""}, {"amount": "abc"}, {"amt": "-5"}]
    got = values(spark, [json.dumps(rows)], lambda c: transactions.normalize_records(F.from_json(c, "array<map<string,string>>")))[0]
    assert [(r.txn.amount, r.txn.direction, r.txn.currency) for r in got] == [(5000.0, None, "INR"), (1.0, "credit", None), (None, None, None), (5.0, "debit", None)]
    assert got[0].txn.transaction_id == "T1" and got[0].txn.extra == {"device": "d"} and got[2].warnings == ["unparseable amount: 'abc'"]


@pytest.fixture(scope="module")
def case(spark):
    rows = [{"case_id": "c1", "text": SMS}, {"case_id": "c1", "text": CHAT}, {"case_id": "c1", "text": ALERT}, {"case_id": "c1", "json": FAILED}, {"case_id": "c1", "text": STATEMENT}, {"case_id": "c1", "text": MAIL}, {"case_id": "c1", "text": ALERT + " "}, {"case_id": "c1", "bytes": PNG},
            {"case_id": "c2", "text": "hello"}, {"case_id": "c2"}, {"case_id": "c2", "text": "x", "forced_type": "nope"}, {"case_id": "c2", "bytes": "h\xe9".encode("latin-1")}]
    evidence = settle(ingest(raw_rows(spark, rows), ocr=lambda b: {"text": "Paid Rs 500 to abc@ybl via UPI txn 12345678AB debited", "engine": "fake", "confidence": 0.5}))
    return evidence, settle(extract(evidence))


def test_ingest(case):
    e = {(r.case_id, r.rec_ord): r for r in case[0].collect()}
    assert [e["c1", i].evidence_type for i in range(8)] == ["message", "message", "transaction", "transaction", "transaction", "message", "transaction", "screenshot"]
    assert len(e["c1", 4].transactions) == 2 and e["c1", 7].ocr.content_type == "transaction" and e["c1", 7].warnings == ["low OCR confidence (0.50)"]
    assert e["c2", 1].warnings and e["c2", 2].warnings and e["c2", 3].metadata["decoding"] == "latin-1" and e["c2", 3].normalized_text == "hé"


def test_missing_ocr_is_a_warning(spark):
    r = ingest(raw_rows(spark, [{"bytes": PNG}]), ocr=lambda b: {"error": "none here"}).first()
    assert r.evidence_type == "screenshot" and r.warnings == ["OCR unavailable: none here"]


def test_extract(case):
    r = {(x.case_id, x.rec_ord): x for x in case[1].collect()}
    assert r["c1", 0].sender.identifier == "VM-SBIINB" and r["c1", 0].urls[0].verdict == "malicious"
    assert (r["c1", 1].sender.name, r["c1", 1].receiver.name, r["c1", 1].timestamp) == ("Ravi Kumar", "Me", "2024-03-12T10:20:00")
    assert (r["c1", 5].sender.identifier, r["c1", 5].message.subject, r["c1", 5].message.content) == ("a@b.com", "KYC", "Share your OTP")
    t = r["c1", 4].transaction
    assert (t.record_count, t.total_debit, t.total_credit, t.max_amount) == (2, 250.0, 1.0, 250.0)


def test_timeline_and_checks(spark, case):
    events, summary = build_timeline(case[1])
    events = settle(events)
    got = {r.sequence: r for r in events.filter("case_id = 'c1'").collect()}
    kinds = [got[i].event_type for i in sorted(got)]
    assert kinds == ["scammer_credit", "suspicious_message", "suspicious_message", "fraud_attempt", "fraudulent_payment", "fraudulent_payment", "transaction", "follow_up_message", "malicious_url", "transaction"]
    assert got[3].since_previous == "5m" and got[7].details.follows_suspicious_contact
    s = summary.filter("case_id = 'c1'").first()
    assert s.total_loss == {"INR": 10000.0} and s.fraudulent_payment_count == 2 and s.suspect_identifiers[-1] == "scam.pay@ybl"
    issues, counts = check(events)
    i = issues.orderBy("case_id", "n").collect()
    mine = [x for x in i if x.case_id == "c1"]
    assert [x.issue_id for x in mine] == [f"ISSUE-{k:03d}" for k in range(1, len(mine) + 1)]
    ranks = [["high", "medium", "low"].index(x.severity) for x in mine]
    assert ranks == sorted(ranks)
    kinds = {x.issue_type for x in mine}
    assert {"missing_timestamp", "date_only_timestamp", "duplicate_transaction", "missing_sender_id", "unlinked_debit", "missing_transaction_id", "requested_amount_mismatch"} <= kinds
    assert counts.filter("case_id = 'c1'").first().issue_count == len(mine)


def test_conflicting_references(spark):
    pay = lambda amount, to, date: json.dumps({"txn_id": "UTR 123456", "amount": amount, "to": to, "date": date, "status": "success" if amount == "5" else "failed"})
    rows = [{"json": pay("5", "a@ybl", "2024-03-12T10:00:00")}, {"json": pay("6", "b@ybl", "2024-03-14T10:00:00")}]
    issues, _ = check(settle(build_timeline(settle(extract(settle(ingest(raw_rows(spark, rows))))))[0]))
    assert {"amount_mismatch", "payee_mismatch", "status_mismatch", "timestamp_mismatch"} <= {r.issue_type for r in issues.collect()}


def test_a_given_midnight_is_a_time(spark):
    pay = lambda date: json.dumps({"txn_id": "T1", "amount": "5", "to": "a@ybl", "date": date})
    dates_given = ["2024-01-11T00:00:00", "2024-01-11", "2024-01-11 00:00:00", "11/01/2024", "2024-01-11T00:00:01"]
    records = settle(extract(settle(ingest(raw_rows(spark, [{"case_id": str(i), "json": pay(d)} for i, d in enumerate(dates_given)])))))
    got = lambda r: [x.time_precision for x in build_timeline(r)[0].orderBy("case_id").collect()]
    assert got(records) == ["datetime", "date", "date", "date", "datetime"]
    older = records.withColumn("transactions", F.transform("transactions", lambda t: t.dropFields("has_time")))
    assert got(older) == ["date", "date", "date", "date", "datetime"]


def test_redaction(spark, case):
    out = redact(case[1])
    dump = json.dumps([r.asDict(True) for r in out.collect()])
    assert "scam.pay@ybl" not in dump and "a@b.com" not in dump and "412345678901" in dump
    got = values(spark, ["mail a.b@c.com, acct no 12345678, card 4111 1111 1111 1111, call 9876543210, XX1234, x@ybl.", "ref 123, 5 rupees, a/c 12", "", None], redact_text)
    assert got == ["mail [REDACTED], acct no [REDACTED], card [REDACTED], call [REDACTED], [REDACTED], [REDACTED].", "ref 123, 5 rupees, a/c 12", "", None]
    with pytest.raises(ValueError):
        redact(case[1], types=["name"])


def test_report(spark, case, tmp_path):
    rows = {r["case_id"]: r for r in (x.asDict(True) for x in build_report(case[1], "2024-04-01T00:00:00+00:00").collect())}
    r = rows["c1"]
    facts = r["executive_summary"]["key_facts"]
    assert r["executive_summary"]["assessment"] == "Fraud with financial loss" and facts["total_loss"] == {"INR": 5000.0} and facts["fraudulent_payment_count"] == 1 and facts["failed_attempt_count"] == 1
    assert "(recorded in 2 documents)" in r["executive_summary"]["text"]
    assert [a["entry"] for a in r["fraud_attempt_log"]] == list(range(1, len(r["fraud_attempt_log"]) + 1))
    assert rows["c2"]["executive_summary"]["assessment"] == "No fraud indicators found"
    plain, table = render.report_text(r), render.report_markdown(r)
    assert all(len(line) <= render.WIDTH for line in plain.split("\n")) and "## 5. Fraud attempt log" in table
    assert "scam.pay@ybl" not in plain + table + json.dumps(r)
    written = render.save_report(r, str(tmp_path / "r.json"), ("json", "text", "markdown"))
    assert sorted(written) == ["json", "markdown", "text"] and json.load(open(written["json"]))["case_id"] == "c1"


def test_store(spark, case, tmp_path):
    records = case[1].filter("case_id = 'c1'")
    merged = upsert(records, records.filter("rec_ord = 2").withColumn("source", F.lit("again")).withColumn("rec_ord", F.lit(0)))
    got = {r.rec_ord: r.source for r in merged.collect()}
    assert len(got) == 8 and got[2] == "again"
    doc = json.loads(case_json(records, "now").first().document)
    assert doc["record_count"] == 8 and doc["records"][0]["evidence_type"] == "message"
    (tmp_path / "d.txt").write_text("# list\n\n Evil.com \n")
    assert [r.domain for r in read_domains(spark, str(tmp_path / "d.txt"), "block").collect()] == ["evil.com"]


def test_empty_tables(spark):
    records = settle(extract(settle(ingest(raw_rows(spark, [])))))
    events, summary = build_timeline(records)
    assert events.count() == 0 and summary.count() == 0 and check(settle(events))[0].count() == 0


def test_stream(spark, tmp_path):
    from siftline.streaming.cases import read_raw, records_stream, update_cases

    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"case_id": "s", "rec_ord": i, "source": "x", "text": t}) for i, t in enumerate([CHAT, ALERT])))
    seen = []
    q = update_cases(records_stream(read_raw(spark, str(src))), store, lambda e, i: seen.append(({r.event_type for r in e.collect()}, i.count())), str(tmp_path / "ck"))
    q.awaitTermination()
    assert seen and "fraudulent_payment" in seen[-1][0]
    assert spark.read.parquet(store).count() == 2
