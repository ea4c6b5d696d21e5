"""Spark jobs over monitoring data, and over training data in the subpackage llm."""
