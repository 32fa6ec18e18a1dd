"""Operators: functions from DataFrame to DataFrame, lazy and free of I/O."""
