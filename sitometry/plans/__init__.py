"""Whole flows from the operators."""
