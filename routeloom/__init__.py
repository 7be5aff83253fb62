"""Typed property graphs of software systems, stored as DataFrames and queried with Spark."""
