"""Reusable DataFrame operators: splits, encodings, ranks, joins, moments, matrices."""
