"""Every registered query and, where SQL can express it, its oracle."""

from __future__ import annotations

from evispark.plans import cascade, concepts, describe, evidence, fixpoint, graph, hierarchy, indexes, linkage, network, orphans, records, search, services, text, upkeep

MODULES = (cascade, concepts, describe, evidence, fixpoint, graph, hierarchy, indexes, linkage, network, orphans, records, search, services, text, upkeep)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
