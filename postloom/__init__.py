"""Spark-native processing of social posts: ingest, dedup, classify, extract, deliver."""
