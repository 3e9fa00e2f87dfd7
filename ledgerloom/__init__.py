"""ledgerloom: ledger analytics and record preparation on Spark DataFrames."""
