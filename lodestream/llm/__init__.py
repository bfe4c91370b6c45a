"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``registry.QUERIES`` and
``registry.ORACLE`` are what ``__spark_entry__.py`` adds to its own.
"""
