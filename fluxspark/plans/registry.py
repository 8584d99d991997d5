"""All registered queries by name."""

from __future__ import annotations

from fluxspark.plans import forecasts, monthly, readings, studies
from fluxspark.plans.bindings import Query


def registered() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in (readings, monthly, studies, forecasts):
        clash = out.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"registered twice: {clash}")
        out |= module.QUERIES
    return out
