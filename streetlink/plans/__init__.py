"""Whole runs put together from the operators: evaluation, pair building, label scoring."""
