"""Whole plans: from files to a graph."""
