"""Transcript analytics on Spark: DataFrame operators over transcripts, rules, metrics and usage records."""
