"""Spark-native retail analytics: sources, quality, KPIs, time series, segments, streaming."""
