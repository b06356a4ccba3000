"""Larkspur: DataFrame-first analytics for content pipelines."""
