"""Continuous use of the batch operators."""
