"""Registered queries."""

from foldline.registry.base import ORACLES, QUERIES


def load():
    from foldline.registry import data_queries, model_queries, plan_queries, search_queries, study_queries  # noqa: F401

    return QUERIES, ORACLES
