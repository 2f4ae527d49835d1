"""Operators: DataFrame -> DataFrame functions, lazy, keyed by partitioning columns."""
