"""Operators: functions from DataFrames to DataFrames, with no input or output of their own."""
