"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; :mod:`casekit.llm.queries` wraps them as
registered queries.
"""
