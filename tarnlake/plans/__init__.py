"""The registered queries, grouped by area, each with its SQL counterpart."""

import importlib
import importlib.util

AREAS = (
    "golden",
    "relational",
    "ingest",
    "declarative",
    "checks",
    "modelling",
    "search",
    "governance",
    "logs",
    "streams",
)


def load_all() -> None:
    for area in AREAS:
        if importlib.util.find_spec(f"tarnlake.plans.{area}"):
            importlib.import_module(f"tarnlake.plans.{area}")
