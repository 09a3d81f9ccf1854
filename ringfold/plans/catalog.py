"""Registered queries and their oracles."""

from __future__ import annotations

from . import queries_data, queries_more


def flagship(spark, sf_dir: str):
    return queries()["flagship"](spark, sf_dir)


def queries() -> dict:
    assert queries_more  # registers its queries beside the others
    return queries_data.QUERIES


def oracle_sql() -> dict[str, str]:
    return queries_data.ORACLE
