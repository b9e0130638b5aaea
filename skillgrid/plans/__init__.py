"""Whole questions answered end to end, built from the operators."""
