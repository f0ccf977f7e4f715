"""Spark-first analytics engine for ensembles of text reports."""
