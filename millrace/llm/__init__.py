"""Corpus preparation for language-model training: ten operators that run as Spark jobs.

Nothing else in the library imports this subpackage.
"""
