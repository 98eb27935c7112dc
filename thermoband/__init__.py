"""Deviation analytics for grouped temperature-logger series, written for Spark."""
