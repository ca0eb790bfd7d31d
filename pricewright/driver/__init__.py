"""Adapters from the driver's sample tables to the canonical schema, the registered queries and their SQL."""
