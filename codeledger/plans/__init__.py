"""Whole jobs: the chained model steps and the registered queries."""
