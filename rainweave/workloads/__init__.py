"""Registered queries: each operator run over the given tables, with equivalent SQL."""

from rainweave.workloads.registry import QUERIES, SQL, load_all

__all__ = ["QUERIES", "SQL", "load_all"]
