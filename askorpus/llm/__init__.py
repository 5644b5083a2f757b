"""Operators for preparing language-model training data.

``queries`` and ``oracle_sql`` list the registered queries; each operator module holds its
general function and, at its end, the thin query that applies it to a whole table.
"""

from __future__ import annotations

from askorpus.llm import registered


def queries():
    return registered.queries()


def oracle_sql():
    return registered.oracle_sql()
