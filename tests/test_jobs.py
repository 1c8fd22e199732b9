"""The jobs one after the other, on one case."""

from __future__ import annotations

import json

import pytest

from siftline.__main__ import main


def test_jobs(spark, tmp_path, capsys):
    at = lambda n: str(tmp_path / n)
    chat, alert = "[12/03/24, 10:20:00 AM] Ravi: Pay Rs 5000 to scam.pay@ybl now", "Rs.5,000.00 debited from A/c XX1234 on 12-03-24 to VPA scam.pay@ybl UPI Ref 412345678901"
    (tmp_path / "block.txt").write_text("evil.com\n")
    (tmp_path / "note.txt").write_text("see http://evil.com/x")
    main(["ingest", at("note.txt"), "--text", chat, "--text", alert, "--case-id", "k", "--out", at("e")])
    main(["extract", at("e"), "--blocklist", at("block.txt"), "--out", at("r")])
    assert any(u.verdict == "malicious" for r in spark.read.parquet(at("r")).collect() for u in r.urls)
    main(["timeline", at("r"), "--case-id", "k", "--format", "text", "--format", "json", "--out", at("t")])
    assert "fraudulent payment" in open(at("t.txt")).read() and json.load(open(at("t.json")))["events"]
    main(["check", at("r"), "--case-id", "k", "--format", "markdown", "--out", at("c")])
    assert "Gaps & contradictions" in open(at("c.md")).read()
    main(["redact", at("r"), "--out", at("x")])
    assert "k upi_id" in capsys.readouterr().err
    main(["report", at("r"), "--case-id", "k", "--format", "text", "--out", at("report.txt")])
    assert "scam.pay@ybl" not in open(at("report.txt")).read()
    with pytest.raises(SystemExit):
        main(["report", at("r"), "--format", "text", "--out", at("z")])
