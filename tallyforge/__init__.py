"""tallyforge: rollout and submission analytics on Spark DataFrames."""
