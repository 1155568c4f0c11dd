"""All queries of the library and their SQL."""

from __future__ import annotations

from shardloom.plans import evaluation, more, pixels, scores


def queries() -> dict:
    return {**pixels.QUERIES, **scores.QUERIES, **more.QUERIES, **evaluation.QUERIES}


def oracle_sql() -> dict:
    return {**pixels.ORACLE, **scores.ORACLE, **more.ORACLE, **evaluation.ORACLE}
