"""Registered queries by family."""

from __future__ import annotations

import importlib

FAMILIES = ("q_functions", "q_sources", "q_catalog", "q_cells", "q_spatial", "q_scores", "q_retrieval",
            "q_text", "q_decide", "q_evaluate", "q_streaming", "q_images")


def load():
    from cellselect.plans import registry
    for family in FAMILIES:
        importlib.import_module(f"cellselect.plans.{family}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
