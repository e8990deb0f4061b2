"""Queries of this package and their SQL."""

import importlib

#: Modules with QUERIES and ORACLE.
MODULES = ("scan", "groups", "terms", "unify", "copies", "neardup", "lexicon", "packing", "residue")

_found = [importlib.import_module(f"quernstone.llm.{m}") for m in MODULES]
QUERIES = {name: q for m in _found for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in _found for name, sql in m.ORACLE.items()}
