"""Operators for building language-model training data: one module per
operator, ``queries`` with the registered queries.  Nothing outside this
folder imports it."""
