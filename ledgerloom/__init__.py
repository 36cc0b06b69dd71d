"""Spark-first analytics for filings, matched cohorts and document collections."""
