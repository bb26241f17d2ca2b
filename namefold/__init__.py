"""namefold: ordered-ledger to current-state analytics on Spark DataFrames."""
