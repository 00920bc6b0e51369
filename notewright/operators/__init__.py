"""Operators: functions from DataFrames of notes to DataFrames of musical structure."""
