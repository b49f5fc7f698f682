"""Operators: functions from DataFrames (and plain configuration) to DataFrames."""
