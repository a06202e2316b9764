"""Checked queries over the given tables."""

import importlib

SECTIONS = [
    "search_plans",
    "engagement_plans",
    "expression_plans",
    "date_plans",
    "place_plans",
    "series_plans",
    "matching_plans",
    "feed_plans",
    "stream_plans",
]


def load_plans():
    """Import every section and return the filled registry."""
    for section in SECTIONS:
        importlib.import_module(f"marquee.plans.{section}")
    return importlib.import_module("marquee.plans.catalog")
