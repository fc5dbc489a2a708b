"""Registered queries over the test tables, each with its SQL twin where SQL can say it."""

from emporia.plans import baskets, cleaning, dialogue, forecasts, indicators, lookups, regions
from emporia.plans.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "baskets", "cleaning", "dialogue", "forecasts", "indicators", "lookups", "regions",
]
