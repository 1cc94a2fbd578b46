"""Registered queries; each module registers its own when it is imported."""

from fabula.plans import files, graphs, items, language, learning, numbers, phrases, reports, rules, sequences, stories, structure, words  # noqa: F401
from fabula.plans.registry import QUERIES, SQL


def queries():
    return QUERIES


def oracle_sql():
    return SQL
