"""Pricing diagnostics on Spark: messy sheets in, typed star schema, per-client analyses out."""
