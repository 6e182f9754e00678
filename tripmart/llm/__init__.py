"""Operators for building training data: filters, deduplication, decontamination, mixing, search."""
