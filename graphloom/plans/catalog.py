"""Imports every module that registers queries."""

from graphloom.plans import bundles, checks, codebase, enrich, graphs, imports, lookups, manifests, relational, releases, services, terrain  # noqa: F401
from graphloom.plans.registry import ORACLES, QUERIES  # noqa: F401
