"""Evidence-ledger analytics on Spark: ordered frames, intervals, records and their audits."""
