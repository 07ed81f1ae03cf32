"""Ordered running aggregates, exact quantiles and tail probabilities."""
