"""Joins, windows, aggregations, selection and resampling over contest tables."""
