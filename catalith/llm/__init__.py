"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  The thin queries over the
test tables are in :mod:`catalith.llm.queries`, their SQL in
:mod:`catalith.llm.oracles`.
"""
