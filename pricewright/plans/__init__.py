"""Whole analyses and layer pipelines built from the operators."""
