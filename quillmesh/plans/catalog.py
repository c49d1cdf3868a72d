"""Imports every query module so that the registry is full."""

from __future__ import annotations

from importlib import import_module

from quillmesh.plans.registry import REGISTRY

MODULES = (
    "streaming_queries",
    "learning_queries",
    "tree_queries",
    "source_queries",
    "sampling_queries",
    "relational_queries",
    "evaluation_queries",
    "cleansing_queries",
    "feature_queries",
    "graph_queries",
    "reach_queries",
)

for _name in MODULES:
    import_module(f"quillmesh.plans.{_name}")

__all__ = ["REGISTRY"]
