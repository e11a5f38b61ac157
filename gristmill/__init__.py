"""Spark-first analytics over sparse evaluation tables, event logs and text corpora."""
