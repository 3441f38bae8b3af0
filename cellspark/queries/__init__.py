"""Registered queries, named ``<id>_<short name>``, and their SQL twins."""

from __future__ import annotations

from cellspark.queries import curation, files, layout, retrieval, vocabulary

QUERIES = {**curation.QUERIES, **layout.QUERIES, **vocabulary.QUERIES, **retrieval.QUERIES, **files.QUERIES}
ORACLES = {**curation.ORACLES, **layout.ORACLES, **vocabulary.ORACLES, **retrieval.ORACLES, **files.ORACLES}
