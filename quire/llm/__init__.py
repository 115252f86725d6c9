"""Operators for preparing language-model training data at scale.

Self-contained: nothing else in the library imports this subpackage.  Each
module holds one operator; ``queries`` registers the ``opN_*`` queries.
"""
