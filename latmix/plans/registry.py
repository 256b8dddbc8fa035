"""All registered queries of the engine's own operators, with their oracle SQL."""

from __future__ import annotations

from . import biases, catalogues, clusters, distributions, extras, headers, histograms, lattices, matrices, mixtures, more, variational, views, warps

MODULES = (mixtures, clusters, histograms, distributions, matrices, lattices, catalogues, extras, warps, biases, headers, more, views, variational)


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
