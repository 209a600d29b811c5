"""Operators: functions from DataFrames to DataFrames, without actions."""
