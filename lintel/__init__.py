"""Linkage, text and time-series analytics expressed as Spark DataFrame plans."""
