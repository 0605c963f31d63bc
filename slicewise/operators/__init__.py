"""Operators: functions from DataFrames to DataFrames; none of them runs a job unless its name says so."""
