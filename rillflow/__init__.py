"""Spark jobs over semi-structured records: sources, checks, merges, questions and streams."""
