"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each operator lives in its own
module with a general interface; ``queries`` holds the thin ``opN_<name>``
wrappers that apply one operator to a whole table.
"""
