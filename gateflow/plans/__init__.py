"""Compositions of operators: the whole flow, and the summary tables."""
