"""Batch jobs over investigative case data, as DataFrame-in, DataFrame-out functions."""
