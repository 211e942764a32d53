"""Operators of a training-data pipeline (numbered 1 to 10) and their queries."""
