"""Import every plan module so its queries register, then expose the registry."""

from __future__ import annotations

import importlib

PLAN_MODULES = [
    "vendora.plans.q_commerce",
    "vendora.plans.q_calendar",
    "vendora.plans.q_baseline",
    "vendora.plans.q_diagnostics",
    "vendora.plans.q_dashboards",
    "vendora.plans.q_relational",
    "vendora.plans.q_sources",
    "vendora.plans.q_models",
    "vendora.plans.q_panel",
    "vendora.plans.q_storage",
]


def registry():
    for m in PLAN_MODULES:
        importlib.import_module(m)
    from vendora.plans.registry import REGISTRY
    return REGISTRY
