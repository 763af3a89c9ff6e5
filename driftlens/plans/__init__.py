"""Whole evaluations and the registered queries."""
