"""Spark-native analytics over question corpora and the study records kept against them."""
