"""Operators: functions from DataFrames (or columns) to DataFrames (or columns), usable with ``df.transform``."""
