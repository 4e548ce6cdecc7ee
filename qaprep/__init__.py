"""Spark jobs that build and judge question-answering training data."""
