"""Named queries: every operator applied to the standard tables."""

from riskframe.plans.catalogue import ORACLES, QUERIES, TABLES, Tables

# Importing a module registers its queries.
for _module in (
    "sources filters joins grouping ranking anomalies text values preparation selection learning explaining"
).split():
    try:
        __import__(f"riskframe.plans.{_module}")
    except ModuleNotFoundError as exc:
        if exc.name != f"riskframe.plans.{_module}":
            raise

__all__ = ["ORACLES", "QUERIES", "TABLES", "Tables"]
