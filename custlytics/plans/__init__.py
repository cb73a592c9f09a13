"""Registered queries: a Spark callable over the parquet tables and, where SQL can say it, the oracle SQL."""
