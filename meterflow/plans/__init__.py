"""Registered queries: each operator applied to the driver tables, with SQL for the same rows."""
