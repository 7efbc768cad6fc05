"""Readers of single formats: bytes in, one string out. They run on executors and know nothing of Spark."""
