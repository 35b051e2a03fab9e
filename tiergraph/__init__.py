"""Multi-tier supply-chain graphs as Spark DataFrames."""
