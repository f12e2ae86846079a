"""Operators for building training corpora at scale.

Nothing else in the library imports this subpackage.  Each operator is a module
with a general interface; ``queries`` binds the thin ``opN_<name>`` queries.
"""
