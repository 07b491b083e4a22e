"""Preference-learning data on Spark: DataFrame operators, sources, and whole-table plans."""
