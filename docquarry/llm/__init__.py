"""Operators for preparing language-model training data, one module each.

Nothing outside this subpackage imports it; ``queries`` lists what it offers to
``__spark_entry__``.
"""
