"""Operators for building training data: formatting, scoring, searching, tokenising, packing and sharding."""
