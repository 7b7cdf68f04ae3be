"""Leak-safe tabular features, out-of-fold evaluation and rank ensembling on Spark."""
