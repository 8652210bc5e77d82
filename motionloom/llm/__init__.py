"""Operators for preparing large text corpora for language-model training.

Nothing else in the library imports this subpackage. Each operator is a module
with a general interface; ``queries`` holds the registered queries and their SQL.
"""
