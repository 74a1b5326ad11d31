"""Query plans: the registry of named queries, their SQL oracles and plan helpers."""
