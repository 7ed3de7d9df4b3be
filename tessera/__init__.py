"""Disclosure analytics on Spark: facts, text, retrieval, verification, drift, features."""
