"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ["secrets", "neighbours", "mixing", "toxicity", "sharding", "decontaminate",
           "suffixdedup", "tokencount", "neardup", "chat", "windowpack",
           "collocations", "ranking"]


def queries():
    found = {}
    for name in MODULES:
        found |= import_module(f"askorpus.llm.{name}").QUERIES
    return found


def oracle_sql():
    found = {}
    for name in MODULES:
        found |= import_module(f"askorpus.llm.{name}").ORACLES
    return found
