"""Whole jobs: forecast run, reporting view and SQL surface."""
