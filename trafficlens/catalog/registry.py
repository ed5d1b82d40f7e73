"""All registered queries and SQL checks."""

from __future__ import annotations

from trafficlens.catalog import (
    feature_oracles,
    feature_queries,
    learning_queries,
    source_queries,
    stream_queries,
)

QUERIES = {
    **feature_queries.QUERIES,
    **source_queries.QUERIES,
    **learning_queries.QUERIES,
    **stream_queries.QUERIES,
}
ORACLES = {
    **feature_oracles.ORACLES,
    **source_queries.ORACLES,
    **learning_queries.ORACLES,
    **stream_queries.ORACLES,
}
