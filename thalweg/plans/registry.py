"""Queries of the network engine and their SQL oracles, by the ids of the operator inventory."""

from __future__ import annotations

from thalweg.plans import extra, graph, model, more, reach

QUERIES = {**graph.QUERIES, **model.QUERIES, **more.QUERIES, **extra.QUERIES, **reach.QUERIES}
ORACLES = {**graph.ORACLES, **model.ORACLES, **more.ORACLES, **extra.ORACLES, **reach.ORACLES}
