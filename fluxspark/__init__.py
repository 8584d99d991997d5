"""Keyed table operators for irregular flux and sensor time series, on Spark."""
