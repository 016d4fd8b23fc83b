"""Operators for preparing training text: one module per operator.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when it is there.
"""
