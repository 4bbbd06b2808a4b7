"""The driver's queries and their SQL oracles, one module per group of operators."""

from __future__ import annotations

import importlib

#: Modules of this package that register queries.
GROUPS: tuple[str, ...] = ("measures", "traverse", "sets", "knowledge", "records", "texts", "repair", "lessons")


def _groups():
    return [importlib.import_module(f"{__name__}.{g}") for g in GROUPS]


def queries():
    out = {}
    for g in _groups():
        out.update(g.QUERIES)
    return out


def oracle_sql():
    out = {}
    for g in _groups():
        out.update(g.ORACLES)
    return out


def flagship(spark, sf_dir):
    """A question's subgraph: its seeds, their neighbourhood behind the hub gate, and the edges inside."""
    from tessera.contract.traverse import QUESTION
    from tessera.operators.traverse import question_subgraph
    from tessera.sources.star import stored_graph

    return question_subgraph(stored_graph(spark, sf_dir), QUESTION, 2, ascii_labels=True)
