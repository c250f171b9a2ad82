"""Operators that prepare large text corpora for training.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own general interface; ``queries`` wires them to the tables.
"""
