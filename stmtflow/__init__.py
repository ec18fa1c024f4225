"""stmtflow: account statement ingestion, dedup, matching and review as Spark jobs."""
