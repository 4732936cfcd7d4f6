"""Operators: functions from data frames to data frames."""
