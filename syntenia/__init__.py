"""Spark-first analytics for microbial pangenomes."""
