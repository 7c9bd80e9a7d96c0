"""Operators for preparing training text and vectors.

Nothing else in the library imports this subpackage.  Each module holds
one operator with a general interface; ``queries.py`` derives the
registered ``opN_*`` results from them.
"""
