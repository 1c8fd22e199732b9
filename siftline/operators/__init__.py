"""DataFrame operators: ingest, extract, timeline, checks, redact, report."""
