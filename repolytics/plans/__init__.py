"""Registered queries: operators over views of the given tables, and the SQL that says the same."""
