"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; the queries it offers are
listed in :mod:`tallyframe.llm.queries` and their SQL in
:mod:`tallyframe.llm.oracle`.
"""
