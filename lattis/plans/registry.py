"""Queries and their DuckDB oracles, by operator key."""

from . import relational, spatial, workflows

QUERIES: dict = {**relational.QUERIES, **spatial.QUERIES, **workflows.QUERIES}
ORACLES: dict = {**relational.ORACLES, **spatial.ORACLES, **workflows.ORACLES}
