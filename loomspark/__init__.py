"""Spark-native preparation and analysis of language-model corpora and experiment logs."""
