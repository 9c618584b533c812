"""Operators that prepare training data for language models.

Nothing outside this folder imports it. Each module holds one operator with a general interface;
``queries.py`` binds the operators to the given tables with their production parameters.
"""
