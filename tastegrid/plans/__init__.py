"""Compositions of operators, and the batch jobs that write tables."""
