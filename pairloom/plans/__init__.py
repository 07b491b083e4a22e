"""Whole-table plans put together from the operators."""
