"""Registered queries: each module pairs a DataFrame plan with the SQL that must agree with it."""

from codeloom.plans.registry import ORACLES, QUERIES


def load():
    from codeloom.plans import (  # noqa: F401
        analysis,
        corpus,
        ingest,
        joins,
        retrieval,
        scoring,
        secrets,
        serving,
        streams,
        text,
        traffic,
        users,
    )

    return QUERIES, ORACLES
