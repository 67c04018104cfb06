"""Operators that prepare language-model training data at corpus scale.

Nothing outside this subpackage imports it.  ``catalog.queries()`` and
``catalog.oracle_sql()`` are what the entry module registers.
"""
