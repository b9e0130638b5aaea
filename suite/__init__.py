"""Registered queries, their inputs and their SQL twins."""
