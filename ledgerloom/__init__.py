"""Investment-ledger analytics on Spark: conform, maintain, report on and check budget ledgers."""
