"""Reading ledger exports and settlement files, and writing records, reports and runs."""
