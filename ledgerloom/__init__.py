"""Spark-native analytics over company filings and text corpora."""
