"""Mapping of the driver tables to the report model, and the registered queries."""
