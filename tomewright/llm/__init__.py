"""Operators for training data: ten of them, their registered queries and shared array code.

Nothing outside this package imports it. ``queries`` holds what ``__spark_entry__`` registers.
"""
