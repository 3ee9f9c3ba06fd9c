"""Registered queries: every operator applied to the given tables, with SQL that says the same.

Each module has ``QUERIES`` (name to a function of session and table folder) and ``SQL`` (name to
a statement over views named like the tables). Queries without SQL cannot be written as one.
"""
