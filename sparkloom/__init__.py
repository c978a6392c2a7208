"""Batch analytics as DataFrame-in, DataFrame-out functions that Catalyst plans."""
