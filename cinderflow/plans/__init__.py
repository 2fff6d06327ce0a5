"""Query plans, oracles and shared plan helpers."""
