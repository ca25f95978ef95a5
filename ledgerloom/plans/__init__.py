"""The registered queries: operators over the driver's tables, and the SQL with the same results."""
