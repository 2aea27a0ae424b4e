"""The registered graph queries and their oracle SQL."""

from loomgraph.plans import datasets, features, figures, learning, records, samples, storage, structures

_MODULES = (samples, structures, figures, features, learning, storage, datasets, records)

QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
