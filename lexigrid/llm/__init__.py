"""Operators for preparing training text: one module per operator.

Nothing outside this package imports it; ``queries`` holds the registered
queries and their SQL.
"""
