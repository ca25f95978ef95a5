"""Double-entry ledger and payment reconciliation analytics on Spark DataFrames."""
