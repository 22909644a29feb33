"""Whole query plans and the registered queries."""
