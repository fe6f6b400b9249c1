"""Operators for preparing training data: one module for each, plus their registered queries."""
