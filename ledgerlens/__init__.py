"""ledgerlens: evidence-ledger analytics on PySpark DataFrames."""
