"""Operators: DataFrame -> DataFrame. No action inside, no clock: what counts as now is an argument."""
