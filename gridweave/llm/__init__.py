"""Operators for preparing training data: each module holds one operator, its registered query and its SQL.

Nothing outside this package imports it. Queries are registered in :mod:`gridweave.llm.registry`.
"""
