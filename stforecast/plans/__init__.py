"""Pipelines built from the operators, and the catalogue of checked queries."""
