"""Operators over record tables: functions from DataFrames to DataFrames."""
