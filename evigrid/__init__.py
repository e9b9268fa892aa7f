"""Spark-native evidence analytics: claims, evidence search, de-duplication, verdicts and reports as DataFrame plans."""
