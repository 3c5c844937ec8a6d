"""Operators: functions from DataFrames to a DataFrame. Times are integer columns (microseconds or minutes) throughout."""
